"""N-gram Jaccard join by PartEnum signatures.

Sets of like size (a level) split the shingle domain into n parts by hash, and each part into PIECES pieces. Two sets
with a Jaccard similarity of 0.8 or more differ in at most k shingles, so in all but k / 2 parts they differ in at most
one, and there they agree on all pieces but one. The signatures of a part are its subsets of all pieces but one, each
by the hash of its shingles; n = k / 2 + 1 + m parts leave more than m equal signatures. Tiny sets have their own
shingles as pieces: themselves and themselves less one shingle.

Equal signatures meet in a shuffle. A few may be lost, where a subset is empty, or `hot`, where more than HOT sets share
it; both are known for each set, and with them the fewest signatures that a pair must share in small buckets (see
Signed). Sets for which nothing is left (near copies in large groups, and texts that are mostly a passage which many
share) also meet the first set of most of their hot buckets; a bucket whose sets are then one component hides no link.
What still isn't covered is split down to single shingles, of which each set signs with its rarest fifth and one more:
two similar sets share one of these.
Where even such a bucket is large, all members meet its most typical one first, and a bucket whose members are by then
in one component is done. Every candidate is verified on whole sets; the components are those of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialscope.llm.common import fields, frugal, frugal_group, planes, slices, small, unplanes, written
from trialscope.llm.components import components

SHINGLE = 5
#: A bucket with more sets is hot; in others a task forms their pairs.
HOT = 32
#: Sets up to this size use subsets less one; a level reaches from one bound to the next, 1.5 times as far.
TINY = 9
#: Signatures a bucket task gets, about.
TASK_SIGNATURES = 1_000_000
#: Differences that hide a part of which so many subsets can be met.
COST = np.array([0, 1, 1, 2])
#: Pieces of a part, and pieces that are summed up at once.
PIECES, CELLS = 3, 1 << 20
#: Other splits tried for a set with too many lost parts.
RETRIES = 3

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _levels() -> tuple[np.ndarray, list[tuple[int, int]]]:
    uppers, u = [], TINY
    while u < 1 << 40:
        u = max(u + 1, u * 3 // 2)
        uppers.append(u)
    shape = []
    for u in uppers:
        k = 2 * u // 9  # sets of sizes r, s differ in at most (r + s) / 9 shingles
        m = max(2, (k + 5) // 6)
        shape.append((k // 2 + 1 + m, k))
    return np.array(uppers), shape


UPPERS, SHAPES = _levels()


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. ASCII letters count as lower case; words are split at ASCII
    white space; fewer than SHINGLE words are one shingle; none, no shingle."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in flat.dictionary.to_pylist()], np.uint64)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    codes = flat.indices.to_numpy()
    ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    if empty >= 0:
        keep = codes != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    words = mixed(hashes)[codes] if len(codes) else np.empty(0, np.uint64)
    n = len(words) - SHINGLE + 1
    grams = np.full(max(n, 0), SHINGLE, np.uint64)
    for i in range(SHINGLE if n > 0 else 0):
        grams = grams * _BASE + words[i : i + n]
    grams = mixed(grams)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                x = x * _BASE + w
            yield mixed(x)
        else:
            yield np.empty(0, np.uint64)


class Signed(NamedTuple):
    """Signatures, the set (its number), spot and split of each, and the set's slack in that split. A spot is the number
    of the part, times 4, and how many of its subsets aren't empty.

    A similar set that shares none of a part's signatures differs in two shingles there if all its subsets can be met,
    in one if some can, in none if none can. So as long as these numbers, over all parts, add up to more than k, a
    similar set shares a signature; slack is what may be missing from the sum."""

    sig: np.ndarray
    owner: np.ndarray
    spot: np.ndarray
    split: np.ndarray
    slack: np.ndarray


def signatures(sets: list[np.ndarray]) -> Signed:
    """All signatures of some sets; a set's don't depend on the others."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = [Signed(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint16), np.empty(0, np.uint8))]
    for i in np.flatnonzero((sizes > 0) & (sizes <= TINY)):
        one = mixed(sets[i])
        sig = mixed(np.append(one.sum() - one, one.sum()) + np.uint64(1))
        out.append(Signed(sig, np.full(len(sig), i), np.arange(len(sig), dtype=np.uint32) * np.uint32(4) + np.uint32(1), np.zeros(len(sig), np.uint16), np.zeros(len(sig), np.uint8)))
    first, last = np.searchsorted(UPPERS, np.maximum(sizes, TINY + 1)), np.searchsorted(UPPERS, sizes * 5 // 4)
    large = sizes * 5 // 4 > TINY
    flat, starts = np.concatenate([np.empty(0, np.uint64), *sets]), np.cumsum(sizes) - sizes
    for level in range(int(first[large].min()), int(last[large].max()) + 1) if large.any() else ():
        everyone = np.flatnonzero(large & (first <= level) & (level <= last))
        some = max(1, CELLS // (SHAPES[level][0] * PIECES))
        for a in range(0, len(everyone), some):
            who = everyone[a : a + some]
            for retry in range(RETRIES + 1):
                if len(who):
                    signed, slack = _split(flat, starts, sizes, who, level, retry)
                    out.append(signed)
                    who = who[slack < 0]
    return Signed(*map(np.concatenate, zip(*out, strict=True)))


def _split(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, who: np.ndarray, level: int, retry: int) -> tuple[Signed, np.ndarray]:
    """The signatures of the sets `who` in one split of a level, and each one's slack, below 0 if too many parts are lost."""
    (n, k), split, size = SHAPES[level], 1 + level * (RETRIES + 1) + retry, sizes[who]
    take = np.repeat(starts[who] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    shingles = flat[take]
    weight = mixed(shingles ^ _MIX1)
    drawn = mixed(shingles + np.array([split], np.uint64) * _BASE) >> np.uint64(20)
    cell = np.repeat(np.arange(len(who)) * n * PIECES, size) + (drawn % np.uint64(n * PIECES)).astype(np.int64)
    total = lambda x: np.bincount(cell, x, len(who) * n * PIECES).astype(np.uint64)  # noqa: E731  exact: below 2**53
    sums = (total((weight >> np.uint64(32)).astype(np.float64)) << np.uint64(32)) + total((weight & np.uint64(0xFFFFFFFF)).astype(np.float64))
    sums, count = sums.reshape(-1, n, PIECES), np.bincount(cell, minlength=len(who) * n * PIECES).reshape(-1, n, PIECES)
    subset = sums.sum(2, keepdims=True) - sums  # each part less one piece
    full = count.sum(2, keepdims=True) > count
    slack = COST[full.sum(2)].sum(1) - k - 1
    if retry == RETRIES:  # all but impossible: empty subsets are signatures too
        full[slack < 0] = True
        slack = COST[full.sum(2)].sum(1) - k - 1
    usable = full.sum(2)
    i, spot, piece = np.nonzero(full)
    sig = mixed(subset[full] + mixed((spot * PIECES + piece).astype(np.uint64) + np.array([split], np.uint64) * _MIX2))
    return Signed(sig, who[i], (spot * 4 + usable[i, spot]).astype(np.uint32), np.full(len(sig), split, np.uint16), np.clip(slack, 0, 255).astype(np.uint8)[i]), slack


@frugal
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [(len(s), int(mixed(s).sum()) - (1 << 63), int(mixed(s ^ _MIX2).sum()) - (1 << 63)) for s in shingle_sets(batch.column("text"))]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "k1", "k2"])


_SIGNED = "part int, sigs binary, docs binary, spots binary, splits binary, slacks binary"


def _sign(parts: int) -> Callable:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            signed = signatures(list(shingle_sets(batch.column("text"))))
            if not len(signed.sig):
                continue
            part, rest = (signed.sig % np.uint64(parts)).astype(np.int32), (signed.sig // np.uint64(parts)) >> np.uint64(8)
            order = np.lexsort((rest, part))
            columns = [x[order] for x in (rest, batch.column("doc_id").to_numpy()[signed.owner], signed.spot, signed.split, signed.slack)]
            used, cuts = np.unique(part[order], return_index=True)
            ends = np.append(cuts[1:], len(order))
            cells = [pa.array([planes(x[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(used), *cells], ["part", "sigs", "docs", "spots", "splits", "slacks"])

    return run


_MET = "a long, b long, split int, slack_a int, slack_b int, shared int, spot int, bucket long"


@frugal_group
def _meet(table: pa.Table) -> pa.Table:
    """Rows of a part: pairs in its small buckets with the signatures they share here (bucket null), and each member of
    hot ones: the part of the set that the signature is of, the bucket, and as b its first member."""
    sig, doc, spot, split, slack = (np.concatenate([np.empty(0, t), *(unplanes(x, t) for x in table.column(c).to_pylist())]) for c, t in (("sigs", np.uint64), ("docs", np.int64), ("spots", np.uint32), ("splits", np.uint16), ("slacks", np.uint8)))
    order = np.lexsort((doc, split, sig))
    sig, doc, spot, split, slack = (x[order] for x in (sig, doc, spot, split, slack))
    new_run = np.concatenate([[True], (sig[1:] != sig[:-1]) | (split[1:] != split[:-1])])
    keep = new_run | np.concatenate([[True], doc[1:] != doc[:-1]])
    sig, doc, spot, split, slack = (x[keep] for x in (sig, doc, spot, split, slack))
    starts = np.flatnonzero(new_run[keep])
    sizes = np.diff(np.append(starts, len(doc)))
    firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= HOT)]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        firsts.append((at[:, None] + i[None, :]).ravel())
        seconds.append((at[:, None] + j[None, :]).ravel())
    x, y = np.concatenate(firsts), np.concatenate(seconds)
    pairs = _counted(x, doc[x], doc[y], split[x])
    rows = np.flatnonzero(np.repeat(sizes > HOT, sizes))
    bucket = mixed(sig[rows] + mixed(split[rows].astype(np.uint64) + np.uint64(table.column("part")[0].as_py()) * _BASE)).astype(np.int64)
    lead = doc[np.repeat(starts, sizes)[rows]]
    a, n, hot = np.append(x[pairs[0]], rows), len(pairs[0]), len(rows)
    both = lambda of_pairs, of_hot, t: pa.concat_arrays([pa.array(of_pairs, t) if of_pairs is not None else pa.nulls(n, t), pa.array(of_hot, t) if of_hot is not None else pa.nulls(hot, t)])
    i32, i64 = pa.int32(), pa.int64()
    second = y[pairs[0]]
    return pa.table({"a": pa.array(doc[a]), "b": both(doc[second], lead, i64), "split": pa.array(split[a].astype(np.int32)), "slack_a": pa.array(slack[a].astype(np.int32)), "slack_b": both(slack[second].astype(np.int32), None, i32), "shared": both(pairs[1].astype(np.int32), None, i32), "spot": both(None, spot[rows].astype(np.int32), i32), "bucket": both(None, bucket, i64)})


def _counted(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and how often it occurs."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.flatnonzero(np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]))
    return order[new], np.diff(np.append(new, len(order)))


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], ["doc", "shingles"])


@frugal
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "left"):
        keep = []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) else 0
            keep.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(small(ids), "doc_id", "left_semi")


def _heat(hot: DataFrame) -> DataFrame:
    """(doc, split, heat, slack): by how much the hot signatures of a set lower the differences that hide it."""
    cost = lambda n: F.when(n >= PIECES, 2).when(n > 0, 1).otherwise(0)
    usable = F.col("spot") % 4
    parts = hot.groupBy("doc", "split", "spot").agg(F.countDistinct("bucket").alias("n"), F.max("slack").alias("slack"))
    lost = cost(usable) - cost(usable - F.col("n"))
    return parts.groupBy("doc", "split").agg(F.sum(lost).alias("heat"), F.max("slack").alias("slack"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least id reachable by links of similarity 0.8).

    A null or text-free document has no shingles and links with nothing. A row with a null id isn't linked and has a
    null component_id. Rows that share an id are one node. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = fields(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    measured = written(own.mapInArrow(_measure, "doc_id long, n_shingles long, k1 long, k2 long"), "measured")
    named = measured.filter("doc_id is not null and n_shingles > 0")
    # Equal sets are one: the least id stands for them.
    same = written(named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("stands"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal-sets")
    doubles = written(named.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    member = named.join(small(same), ["k1", "k2", "n_shingles"]).select("doc_id", "stands").filter("doc_id <> stands")
    stands_in = written(member.join(doubles, "doc_id", "left_anti"), "stood-for")
    alone = own.filter("doc_id is not null and text is not null").join(small(stands_in.select("doc_id")), "doc_id", "left_anti")

    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_SIGNATURES) + 1)
    met = written(alone.mapInArrow(_sign(parts), _SIGNED).groupBy("part").applyInArrow(_meet, _MET), "met")
    hot = met.filter("bucket is not null").select(F.col("a").alias("doc"), F.col("b").alias("lead"), "split", "spot", "bucket", F.col("slack_a").alias("slack"))
    heat = written(_heat(hot), "heat")
    pairs = met.filter("bucket is null").groupBy("a", "b", "split").agg(F.sum("shared").alias("shared"), F.max("slack_a").alias("slack_a"), F.max("slack_b").alias("slack_b"))
    for side in "ab":
        pairs = pairs.join(small(heat.select(F.col("doc").alias(side), "split", F.col("heat").alias(f"heat_{side}"))), [side, "split"], "left")
    spare = [F.ceil((F.col(f"slack_{s}") - F.coalesce(f"heat_{s}", F.lit(0)) + 1) / 2) for s in "ab"]
    pairs = pairs.filter(F.col("shared") >= F.greatest(F.lit(1), *spare)).select("a", "b").distinct()
    crowded = small(written(heat.filter("heat > slack").select("doc").distinct(), "crowded"))
    own = hot.join(crowded, "doc", "left_semi")
    led = own.groupBy("doc", "lead").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    pairs = written(pairs.unionByName(led.filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b"))), "candidates")

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(crowded).distinct()
    sets = written(_only(alone, written(wanted, "wanted")).mapInArrow(_sets, "doc long, shingles binary"), "sets")
    edges = written(_verified(pairs, sets).unionByName(member.join(small(doubles), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("stands").alias("b"))), "links")
    labels = written(components(edges), "labels")
    # a hot bucket whose members are one component by now hides no link
    named_hot = hot.join(small(labels.withColumnRenamed("node", "doc")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    unlike = named_hot.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    unsafe = written(_heat(own.join(small(written(unlike, "unlike")), "bucket", "left_semi")).filter("heat > slack").select("doc").distinct(), "unsafe")
    open_, turn = _rarest(sets.join(small(unsafe), "doc", "left_semi")), 0
    while not open_.isEmpty():
        open_, tried = _round(open_, labels, turn)
        edges = written(edges.unionByName(_verified(tried, sets)), "links")
        labels = written(components(edges), "labels")
        open_, turn = written(open_, "open"), turn + 1
    rows = measured.join(small(same), ["k1", "k2", "n_shingles"], "left").withColumn("node", F.coalesce("stands", "doc_id"))
    rows = rows.join(small(labels), "node", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"))


@frugal
def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "shingles"):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        n = [len(x) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("doc").to_numpy(), n)), pa.array(np.concatenate(sets)), pa.array(np.repeat(n, n).astype(np.int32))], ["a", "bucket", "size"])


def _rarest(sets: DataFrame) -> DataFrame:
    """(a, bucket, size, rank, typical): the shingles that a set signs with, its rarest fifth and one more in an order
    common to all sets; rank is a shingle's place in it, typical the mean number of sets that have the set's shingles."""
    rows = sets.mapInArrow(_shingle_rows, "a long, bucket long, size int")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("df"))
    ranked = F.row_number().over(Window.partitionBy("a").orderBy("df", "bucket"))
    typical = F.avg("df").over(Window.partitionBy("a"))
    signed = rows.join(shared, "bucket").select("a", "bucket", "size", "df", ranked.alias("rank"), typical.alias("typical"))
    return written(signed.filter((F.col("rank") <= F.floor(F.col("size") / 5) + 1) & (F.col("df") > 1)).select("a", "bucket", "size", "rank", "typical"), "open")


def _round(open_: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Buckets that still hold two components, without those members that lead this turn, and the pairs to verify: each
    leader with every member of another component. In a small bucket all lead; in a large one first the most typical
    member, from the second turn on also 16**turn members by hash, so that the turns are logarithmic."""
    label = small(labels.select(F.col("node").alias("a"), F.col("component").alias("label")))
    rows = open_.join(label, "a", "left").withColumn("label", F.coalesce("label", "a"))
    state = rows.groupBy("bucket").agg(F.max_by("a", F.struct("typical", "a")).alias("first"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    live = rows.join(small(written(state.select("bucket", "first", "n"), "mixed")), "bucket")
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(16**turn))).cast("long")
    leads = (F.col("n") <= HOT) | (F.col("a") == F.col("first")) | (F.lit(turn > 0) & (F.pmod(F.xxhash64("a"), share) == 0))
    live = written(live.select("a", "bucket", "size", "rank", "typical", "label", leads.alias("leads")), "live")
    leaders = live.filter("leads").select("bucket", F.col("a").alias("b"), F.col("label").alias("lead_label"), F.col("size").alias("lead_size"), F.col("rank").alias("lead_rank"))
    # sizes that can be similar, and enough shingles after the shared one, as at a pair's first shared shingle
    likely = "5 * least(size, lead_size) >= 4 * greatest(size, lead_size) and 9 * (1 + least(size - rank, lead_size - lead_rank)) >= 4 * (size + lead_size)"
    tried = live.join(leaders, "bucket").filter(f"label <> lead_label and (not leads or a < b) and {likely}").select("a", "b").distinct()
    return live.filter("not leads").select("a", "bucket", "size", "rank", "typical"), written(tried, "tried")


def near_duplicate_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. Rows with a null id stay."""
    gone = written(similar_components(docs, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "near-copies")
    gone = small(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == gone["__id"], "left_anti")
