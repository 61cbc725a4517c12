"""A manifest of a table as Merkle trees, one a language, under a common root, with a proof for each row.

Leaves are digests made on the JVM. They are ranked within their tree by range, and packed in aligned blocks of 2 ** BITS
leaves. Block roots are leaves of the next tree up, until one block holds them all. Down again, each block's leaves get
their proofs by Merkle traversal: a path of siblings is advanced leaf by leaf, as a schedule of treehash stacks builds
the siblings that later leaves need, and the path above the block, which all its leaves share, is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, fresh, frugal, frugal_group, ranked, small, written

#: A block has 2 ** BITS leaves.
BITS = 12
#: What a row's digest covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 over the values: - for null, else their UTF-8 bytes' number, a colon and the value."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.encode(F.concat(*(one(v.cast("string")) for v in values)), "UTF-8"), 256)


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def height_of(leaves: int) -> int:
    """Levels above the leaves: none for a lone leaf."""
    return (max(leaves, 1) - 1).bit_length()


class Treehash:
    """Builds one node from its leaves, a leaf or a hash at a time, holding at most one node a level and one more.

    Where leaves end early, the last node of a level has no sibling and is hashed alone.
    """

    def __init__(self, leaf: Callable[[int], bytes], count: int):
        self.leaf, self.count = leaf, count
        self.begin(count, 0)

    def begin(self, first: int, height: int) -> Treehash:
        self.next, self.end, self.height = first, min(first + (1 << height), self.count), height
        self.nodes: list[tuple[int, bytes]] = []
        return self

    @property
    def absent(self) -> bool:
        return not self.nodes and self.next >= self.end

    @property
    def low(self) -> float:
        """The schedule's priority: the lowest node's height; that of the goal before the first leaf, none when done."""
        if self.absent or self.done:
            return float("inf")
        return self.nodes[-1][0] if self.nodes else self.height

    @property
    def done(self) -> bool:
        return len(self.nodes) == 1 and self.nodes[0][0] == self.height

    def step(self) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            (h, right), (_, left) = nodes.pop(), nodes.pop()
            nodes.append((h + 1, parent(left, right)))
        elif self.next < self.end:
            nodes.append((0, self.leaf(self.next)))
            self.next += 1
        else:
            h, alone = nodes.pop()
            nodes.append((h + 1, parent(alone)))

    def finish(self) -> bytes | None:
        if self.absent:
            return None
        while not self.done:
            self.step()
        return self.nodes[0][1]


def root_of(leaf: Callable[[int], bytes], count: int, height: int) -> bytes:
    return Treehash(leaf, count).begin(0, height).finish()


def traverse(leaf: Callable[[int], bytes], count: int, height: int, held: list[int] | None = None) -> Iterator[list[bytes | None]]:
    """The siblings of each leaf in turn, lowest first; None where a node has none.

    Between two leaves the stacks get 2 * height steps, each to the stack whose lowest node is lowest: so every sibling
    is ready when it is needed, and all stacks together hold a number of nodes in proportion to the height. held, if
    given, gets that number after each leaf.
    """
    path = [Treehash(leaf, count).begin(1 << h, h).finish() for h in range(height)]
    stacks = [Treehash(leaf, count).begin(0, h) for h in range(height)]
    for s in stacks:
        s.finish()
    for i in range(count):
        yield path
        for h, s in enumerate(stacks):
            if (i + 1) % (1 << h):
                break
            path[h] = s.finish()
            s.begin((i + 1 + (1 << h)) ^ (1 << h), h)
        for _ in range(2 * height):
            lowest = min(stacks, key=lambda s: s.low)  # the first of equals
            if lowest.low == float("inf"):
                break
            lowest.step()
        if held is not None:
            held.append(sum(len(s.nodes) for s in stacks))


def _pack(bits: int, kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    @frugal_group
    def run(table: pa.Table) -> pa.Table:
        """The leaves of one aligned block as one row, with its root."""
        table = table.sort_by("rank").combine_chunks()
        n, nodes = table.column("n")[0].as_py(), table.column("node").to_pylist()
        height = min(height_of(n), bits)
        top = root_of(lambda i: nodes[i].hex().encode(), len(nodes), height)
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(nodes)], pa.int32()), table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0))
        columns = {"tree": table.column("tree")[:1], "block": table.column("block")[:1], "n": table.column("n")[:1], "ids": one("id").cast(pa.list_(kind)), "nodes": pa.array([b"".join(nodes)], pa.binary()), "claims": one("claim"), "top": pa.array([bytes.fromhex(top.decode())], pa.binary())}
        return pa.table(columns)

    return run


def _proofs(bits: int, ids: pa.DataType) -> Callable:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("tree", "block", "n", "nodes", "path", "steps", "top_path", "top_steps", "subroot", "root")}
                raw, count = row["nodes"], len(row["nodes"]) // 32
                leaf = lambda i, raw=raw: raw[32 * i : 32 * i + 32].hex().encode()
                height = min(height_of(row["n"]), bits)
                above, turns = row["path"] + row["top_path"], row["steps"] + row["top_steps"]
                paths, steps = [], []
                for i, siblings in enumerate(traverse(leaf, count, height)):
                    paths.append(b"".join(x for x in siblings if x is not None).decode() + above)
                    steps.append("".join("-" if x is None else "L" if i >> h & 1 else "R" for h, x in enumerate(siblings)) + turns)
                same = lambda v, t, count=count: pa.repeat(pa.scalar(v, t), count)
                columns = {
                    "tree": same(row["tree"], pa.int64()),
                    "rank": pa.array(range(row["block"] << bits, (row["block"] << bits) + count), pa.int64()),
                    "id": batch.column("ids")[k].values.cast(ids),
                    "leaf": pa.array([leaf(i).decode() for i in range(count)]),
                    "claim": batch.column("claims")[k].values,
                    "path": pa.array(paths, pa.string()),
                    "steps": pa.array(steps, pa.string()),
                    "subroot": same(row["subroot"], pa.string()),
                    "root": same(row["root"], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes: tree, rank, n, node, id, claim. One row a block."""
    kind = nodes.schema["id"].dataType
    arrow = pa.field("id", _arrow(nodes, "id")).type
    schema = f"tree long, block long, n long, ids array<{kind.simpleString()}>, nodes binary, claims array<binary>, top binary"
    packed = nodes.withColumn("block", F.shiftright("rank", bits)).groupBy("tree", "block").applyInArrow(_pack(bits, arrow), schema)
    return written(packed, "merkle-blocks")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _expand(blocks: DataFrame, above: DataFrame, tops: DataFrame, bits: int) -> DataFrame:
    """The nodes of blocks with their whole paths: above has (tree, rank of the block) and the path from its root to its
    tree's, tops has (tree) and the path from there to the common root."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    ids = _arrow(blocks, "ids").value_type
    a = small(above.select(F.col("tree").alias("a_tree"), F.col("rank").alias("a_rank"), "path", "steps", "subroot"))
    t = small(tops.select(F.col("tree").alias("t_tree"), F.col("path").alias("top_path"), F.col("steps").alias("top_steps"), "root"))
    joined = blocks.join(a, (F.col("tree") == F.col("a_tree")) & (F.col("block") == F.col("a_rank"))).join(t, F.col("tree") == F.col("t_tree"))
    joined = joined.select("tree", "block", "n", "ids", "nodes", "claims", "path", "steps", "top_path", "top_steps", "subroot", "root")
    return joined.mapInArrow(_proofs(bits, ids), f"tree long, rank long, id {kind}, leaf string, claim binary, path string, steps string, subroot string, root string")


def _climbed(nodes: DataFrame, bits: int) -> DataFrame:
    """tree, rank, path, steps, subroot of nodes (tree, rank, n, node): the way up to their own tree's root. Each turn
    has 2 ** -bits of the nodes of the one below."""
    if nodes.filter("n > 1").isEmpty():  # a root by itself: no way is left
        return nodes.select("tree", "rank", F.lit("").alias("path"), F.lit("").alias("steps"), F.lower(F.hex("node")).alias("subroot"))
    blocks = _blocks(nodes.select("tree", "rank", "n", "node", F.col("rank").alias("id"), F.lit(None).cast("binary").alias("claim")), bits)
    above = _climbed(_roots(blocks, bits), bits)
    tops = blocks.select("tree").distinct().select("tree", F.lit("").alias("path"), F.lit("").alias("steps"), F.lit("").alias("root"))
    return written(_expand(blocks, above, tops, bits).select("tree", "rank", "path", "steps", "subroot"), "merkle-paths")


def _roots(blocks: DataFrame, bits: int) -> DataFrame:
    return blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / F.lit(1 << bits)).cast("long").alias("n"), F.col("top").alias("node"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", covered: tuple[str, ...] = COVERED, claim: Column | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, claim, path, steps, subroot, root.

    path holds the siblings' digests from the leaf to the common root, one after the other; steps says for each level
    whether the sibling stands left (L) or right (R), or that there is none (-) and the node is hashed alone. claim is a
    second digest to hold against the tree (hex; null: the leaf itself), an expression over docs.

    The leaves of a group ascend by id, null ids first, rows of the same id by digest; repeated rows are leaves each. A
    null group is a group of its own, before all others. Only the columns named are read, so others cannot clash; an
    empty table gives no rows. Texts are hashed whole on the JVM, and nothing but digests and ids is shuffled.
    """
    digest = leaf_digest(*(F.col(f"`{c}`") for c in covered))
    other = F.lit(None).cast("string") if claim is None else claim
    name = fresh(docs, "claim")
    own = docs.withColumn(name, other).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("lang"), F.unhex(digest).alias("node"), F.unhex(F.when(F.col(name) != digest, F.col(name))).alias("claim"))
    leaves = ranked(own, "lang", "id", "node", name="merkle-leaves")
    blocks = _blocks(leaves.select("tree", "rank", "n", "node", "id", "claim"), bits)
    above = _climbed(_roots(blocks, bits), bits)
    subroots = above.filter("rank = 0").select("tree", F.unhex("subroot").alias("node"), F.lit(True).alias("all"))
    forest = ranked(subroots.withColumnRenamed("tree", "grove"), "all", "grove", name="merkle-subroots")
    tops = _climbed(forest.select("tree", "rank", "n", "node"), bits).join(forest.select("grove", F.col("rank").alias("place")), F.col("rank") == F.col("place"))
    tops = written(tops.select(F.col("grove").alias("tree"), "path", "steps", F.col("subroot").alias("root")), "merkle-tops")
    out = _expand(blocks, above, tops, bits)
    return out.select(F.col("id").alias("doc_id"), "leaf", F.coalesce(F.lower(F.hex("claim")), "leaf").alias("claim"), "path", "steps", "subroot", "root")


def fold(leaf: Column, path: Column, steps: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(state: Column, step: Column) -> Column:
        node, at = state["node"], state["at"]
        sibling = F.substring(path, at, F.lit(HEX))
        pair = F.when(step == "-", node).when(step == "L", F.concat(sibling, node)).otherwise(F.concat(node, sibling))
        return F.struct(F.sha2(F.encode(pair, "UTF-8"), 256).alias("node"), F.when(step == "-", at).otherwise(at + HEX).alias("at"))

    turns = F.filter(F.split(steps, ""), lambda s: s != "")
    return F.aggregate(turns, F.struct(leaf.alias("node"), F.lit(1).alias("at")), up, lambda s: s["node"])


def verified(docs: DataFrame) -> DataFrame:
    """documents' manifest, its proofs tried on rows of which every seventh (by crc32 of the id) was tampered with."""
    own = fields(docs, **{c: c for c in COVERED})
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = leaf_digest(*(tampered if c == "n_chars" else F.col(c) for c in COVERED))
    m = manifest(own, claim=claim)
    folded = m.withColumn("folded_root", fold(F.col("claim"), F.col("path"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(F.encode("path", "UTF-8"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
