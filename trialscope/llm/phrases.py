"""Phrases that stand together more often than their parts would by chance, mined by pivot partitioning.

Texts become chunks of word codes. Words found in at least `least` places are ranked by frequency, a rank a word. For
each place in a text its word is the pivot of a fragment: the neighbours on either side up to the first that is rarer
than the pivot (on the left also: as rare), as no phrase beyond belongs to it. So each occurrence of a phrase lies in
one fragment, that of its rarest word's leftmost place. Fragments alike are counted once a chunk and dealt by pivot; each
part mines its own and counts only phrases that hold the pivot, which no other part counts. A pivot with more than SPLIT
places is dealt over several parts, whose counts are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.llm.common import bucketed, fields, frugal, frugal_group, planes, ranked, size_of, small, text_of, unplanes, written

LONGEST, LEAST, TOP, SCALE = 5, 100, 2000, 1000
#: Bytes of one language's text that become a chunk, and of all languages' that a task holds.
CHUNK_BYTES, HELD_BYTES = 8 << 20, 32 << 20
#: Places of pivots that a part mines, about; a pivot with more than SPLIT places is dealt over several parts.
PART, SPLIT = 1_000_000, 250_000
#: Bytes of the list of frequent words that every task may get; a longer one is joined to the chunks' own words.
LIST_BYTES = 16 << 20
#: Parts to which a chunk is dealt at once; if there are more, it goes to groups of parts first.
FAN = 4096
#: Columns of a fragment: the neighbours within reach, the pivot in the middle.
REACH = LONGEST - 1
WIDTH = 2 * REACH + 1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _cut(raw: bytes, most: int) -> Iterator[bytes]:
    """raw in runs of about `most` bytes, cut between pieces; a piece stays whole, however long."""
    at = 0
    while len(raw) - at > most:
        end = raw.rfind(b"\n", at, at + most)
        end = raw.find(b"\n", at + most) if end < 0 else end
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def codes_of(raw: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a text of words, spaces and line feeds between pieces, most frequent first; their counts;
    the places' codes: 0 between pieces, else 1 and more."""
    flat = pc.split_pattern(pa.array([raw.replace(b"\n", b" \n ")], pa.large_binary()), " ").values
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(words))
    order = np.array([i for i in np.argsort(-counts, kind="stable").tolist() if words[i] != b"\n"], np.int64)
    place = np.zeros(len(words), np.uint32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
    return [words[i].decode("utf-8", "surrogatepass") for i in order], counts[order], place[codes] if len(codes) else np.empty(0, np.uint32)


@frugal
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    made = 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal made
        sizes.pop(lang)
        words, counts, codes = codes_of(b"\n".join(held.pop(lang)))
        made += 1
        row = {
            "chunk": pa.array([(TaskContext.get().partitionId() << 24) + made], pa.int64()),
            "lang": pa.array([lang], pa.string()),
            "n": pa.array([int(counts.sum())], pa.int64()),
            "words": pa.array([words], pa.list_(pa.string())),
            "counts": pa.array([counts], pa.list_(pa.int64())),
            "codes": pa.array([planes(codes)], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(row.values()), list(row))

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_py()
            for run in _cut(text.cast(pa.binary()).as_py().translate(_LOWER), CHUNK_BYTES):
                held.setdefault(lang, []).append(run)
                sizes[lang] = sizes.get(lang, 0) + len(run) + 1
                if sizes[lang] >= CHUNK_BYTES:
                    yield flush(lang)
                while sum(sizes.values()) > HELD_BYTES:
                    yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)


def fragments(ranks: np.ndarray) -> np.ndarray:
    """One row a place that holds a word and has a neighbour in reach. ranks: by place, 1 the most frequent word, 0 where
    no phrase can pass. Columns: the ranks around the pivot, which is in the middle; 0 out of its reach."""
    n = len(ranks)
    padded = np.concatenate([np.zeros(REACH, ranks.dtype), ranks, np.zeros(REACH, ranks.dtype)])
    out = np.zeros((n, WIDTH), ranks.dtype)
    out[:, REACH] = ranks
    for step, bound in ((-1, np.less), (1, np.less_equal)):
        open_ = ranks > 0
        for k in range(1, LONGEST):
            side = padded[REACH + step * k : REACH + step * k + n]
            open_ = open_ & (side > 0) & bound(side, ranks)
            out[:, REACH + step * k] = np.where(open_, side, 0)
    return out[(out[:, REACH - 1] > 0) | (out[:, REACH + 1] > 0)]


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """One number a row, the same for two rows if and only if they hold the same ranks."""
    key, width = np.zeros(len(columns[0]), np.uint64), 0
    for c in columns:
        bits = int(c.max()).bit_length() if len(c) else 0
        if width + bits > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            width = int(key.max()).bit_length()
        key, width = (key << np.uint64(bits)) | c.astype(np.uint64), width + bits
    return key


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the sum of its weights."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return order[starts], np.add.reduceat(weights[order], starts) if len(keys) else weights[:0]


def merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments alike as one, with the sum of their weights."""
    at, sums = grouped(keys_of(list(rows.T)), weights)
    return rows[at], sums


def mined(rows: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of each length (a matrix of ranks) that hold the pivots of fragments, with their counts from least on."""
    for length in range(2, LONGEST + 1):
        starts = [s for s in range(REACH - length + 1, REACH + 1)]
        has = [np.flatnonzero((rows[:, s] > 0) & (rows[:, s + length - 1] > 0)) for s in starts]
        phrases = np.concatenate([rows[i, s : s + length] for i, s in zip(has, starts, strict=True)])
        if len(phrases):
            at, sums = grouped(keys_of(list(phrases.T)), np.concatenate([weights[i] for i in has]))
            keep = sums >= least
            yield phrases[at[keep]], sums[keep]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of whole numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.array(0x9E3779B97F4A7C15, np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.array(0xBF58476D1CE4E5B9, np.uint64)
    return x ^ (x >> np.uint64(32))


_DEALT = "tree long, parts long, chunk long, part long, split boolean, rows binary, weights binary, to binary"


def _dealt(tree: int, parts: int, chunk: int, to: np.ndarray, split: np.ndarray, rows: np.ndarray, weights: np.ndarray, groups: int | None = None) -> pa.Table:
    """A row for each part and whether its pivots are split, with its fragments; or for each of so many groups of parts,
    with the part of each fragment beside it."""
    part = to if groups is None else to % groups
    order = np.lexsort((rows[:, REACH], split, part))
    key = part[order] * 2 + split[order]
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
    own = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(own)
    columns = {
        "tree": pa.array([tree] * n, pa.int64()),
        "parts": pa.array([parts] * n, pa.int64()),
        "chunk": pa.array([chunk] * n, pa.int64()),
        "part": pa.array([int(part[i[0]]) for i in own], pa.int64()),
        "split": pa.array([bool(split[i[0]]) for i in own], pa.bool_()),
        "rows": pa.array([planes(rows[i].T.ravel()) for i in own], pa.binary()),
        "weights": pa.array([planes(weights[i].astype(np.uint32)) for i in own], pa.binary()),
        "to": pa.array([b"" if groups is None else planes(to[i]) for i in own], pa.binary()),
    }
    return pa.table(columns)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [unplanes(x.as_py(), np.uint32).reshape(WIDTH, -1).T for x in table.column("rows")]
    weights = [unplanes(x.as_py(), np.uint32) for x in table.column("weights")]
    return np.concatenate(rows), np.concatenate(weights).astype(np.int64)


def _fragments_of(codes: np.ndarray, code: np.ndarray, rank: np.ndarray, f: np.ndarray, tree: int, parts: int, chunk: int, split: int, fan: int) -> pa.Table:
    """The fragments of one chunk, alike ones counted, by part, from the ranks and counts of its frequent words' codes. A
    split pivot's go where the chunk's number says."""
    rank_of = np.zeros(max(int(codes.max(initial=0)), int(code.max())) + 1, np.uint32)
    rank_of[code] = rank + 1
    times = np.ones(int(rank.max()) + 2, np.int64)  # by rank: the parts that a pivot is dealt over
    times[rank + 1] = -(-f // split)
    rows = fragments(rank_of[codes])
    rows, weights = merged(rows, np.ones(len(rows), np.int64))
    pivot = rows[:, REACH].astype(np.uint64)
    salt = _mixed(np.full(1, chunk)) % times[pivot].astype(np.uint64)
    to = (_mixed((pivot << np.uint64(24)) + salt) % np.uint64(parts)).astype(np.int64)
    return _dealt(tree, parts, chunk, to, times[pivot] > 1, rows, weights, None if parts <= fan else fan)


def _fragment_chunk(split: int, fan: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = np.empty(0, np.int64)
            return _dealt(0, 1, 0, none, none, np.empty((0, WIDTH), np.uint32), none)
        known = right.column("words")[0].values
        code, rank, f = (known.field(k).to_numpy() for k in range(3))
        return _fragments_of(unplanes(left.column("codes")[0].as_py(), np.uint32), code, rank, f, right.column("tree")[0].as_py(), right.column("parts")[0].as_py(), left.column("chunk")[0].as_py(), split, fan)

    return run


def _fragment_chunks(known, split: int, fan: int) -> Callable:
    """The same where the list of frequent words is small enough for every task: known has, by language, its number, its
    parts, and the rank and count of each word."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree, parts, of = known.value.get(batch.column("lang")[k].as_py(), (0, 0, {}))
                found = [(code, *of[w]) for code, w in enumerate(batch.column("words")[k].as_py(), 1) if w in of]
                if found:
                    code, rank, f = np.array(found, np.int64).T
                    yield from _fragments_of(unplanes(batch.column("codes")[k].as_py(), np.uint32), code, rank, f, tree, parts, batch.column("chunk")[k].as_py(), split, fan).to_batches()

    return run


@frugal_group
def _deal_again(table: pa.Table) -> pa.Table:
    """The fragments that some chunks sent to one group of parts, by part."""
    rows, weights = _unpacked(table)
    to = [unplanes(x.as_py(), np.int64) for x in table.column("to")]
    split = np.repeat(table.column("split").to_numpy(), [len(x) for x in to])
    return _dealt(table.column("tree")[0].as_py(), table.column("parts")[0].as_py(), 0, np.concatenate(to), split, rows, weights)


def _mine(least: int) -> Callable[[pa.Table], pa.Table]:
    @frugal_group
    def run(table: pa.Table) -> pa.Table:
        """The phrases of one part: those found often enough, or all, with what this part has of them, if its pivots
        are split."""
        tree, split = table.column("tree")[0].as_py(), table.column("split")[0].as_py()
        rows, weights = merged(*_unpacked(table))
        lengths, ranks, counts = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for phrases, sums in mined(rows, weights, 1 if split else least):
            lengths.append(np.full(len(sums), phrases.shape[1], np.int64))
            ranks.append(phrases.ravel().astype(np.int32) - 1)
            counts.append(sums)
        ends, found = np.cumsum(np.concatenate(lengths)), np.concatenate(counts)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ranks)))
        return pa.table({"tree": pa.array(np.full(len(found), tree), pa.int64()), "ids": ids, "a": pa.array(found, pa.int64())})

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of 2 to LONGEST words found in at least `least` places of a language's texts, as (tree, ids, a): the
    language's number, its words' ranks, its count; the words (tree, id, word, f); the languages (tree, lang, n).

    Languages without a word that is found so often are left out.
    """
    spark = docs.sparkSession
    own = fields(docs, text=text_col, lang=lang_col).select(text_of(), F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    own = own.toDF("text", "lang")
    chunks = bucketed(own.mapInArrow(_chunks, "chunk long, lang string, n long, words array<string>, counts array<long>, codes binary"), "chunks", "chunk")
    each = chunks.select(F.col("chunk").alias("of"), "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("of", "lang", (F.col("code") + 1).alias("code"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    often = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("order", -F.col("f"))
    words = ranked(often, "lang", "order", "word", name="phrase-words").select("tree", "lang", F.col("rank").cast("int").alias("id"), "word", "f")
    words = written(words, "phrase-words")
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = written(words.groupBy("tree", "lang").agg(F.sum("f").alias("places")).join(totals, "lang").select("tree", "lang", "n", F.ceil(F.col("places") / F.lit(PART)).cast("long").alias("parts")), "phrase-langs")
    known = words.join(langs.select("tree", "parts"), "tree").select("lang", "tree", "parts", "word", "id", "f")
    if size_of(known) <= LIST_BYTES:
        by_lang: dict[str, tuple[int, int, dict[str, tuple[int, int]]]] = {}
        for r in known.toLocalIterator():
            by_lang.setdefault(r.lang, (r.tree, r.parts, {}))[2][r.word] = (r.id, r.f)
        dealt = chunks.select("chunk", "lang", "words", "codes").mapInArrow(_fragment_chunks(spark.sparkContext.broadcast(by_lang), SPLIT, FAN), _DEALT)
    else:
        mapping = each.select("of", "lang", "code", "word").join(known, ["lang", "word"]).groupBy("of", "tree", "parts").agg(F.collect_list(F.struct("code", "id", "f")).alias("words"))
        left, right = chunks.select("chunk", "codes").groupBy("chunk"), mapping.select("of", "tree", "parts", "words").groupBy("of")
        dealt = left.cogroup(right).applyInArrow(_fragment_chunk(SPLIT, FAN), _DEALT)
    most = langs.agg(F.max("parts")).first()[0] or 0
    if most > FAN:  # a chunk's share of a group of parts is small: so many chunks' shares are dealt together
        again = written(dealt, "phrase-groups").withColumn("some", F.pmod(F.xxhash64("chunk"), F.lit(-(-most // FAN))))
        few, many = again.filter(F.col("parts") <= FAN).drop("some"), again.filter(F.col("parts") > FAN)
        dealt = few.unionByName(many.groupBy("tree", "part", "some").applyInArrow(lambda t: _deal_again(t.drop(["some"])), _DEALT))
    found = dealt.groupBy("tree", "part", "split").applyInArrow(_mine(least), "tree long, ids array<int>, a long")
    phrases = found.groupBy("tree", "ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return written(phrases, "phrases"), words, langs


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then a, then phrase.

    A phrase's score is that of its weakest cut in two parts: floor(SCALE * a * n / (l * r)), with exact arithmetic, of
    equal ones the first. Phrases that lie in a longer one that is as frequent are left out. A null text counts as
    empty, a null language as `und`; repeated rows count each; texts are read whole, other columns not at all. An empty
    table, or one without frequent words, gives no rows.
    """
    phrases, words, langs = frequent_phrases(docs, text_col, lang_col, least)
    size = F.size("ids")
    # a longer phrase that is as frequent has one a word longer, as frequent too, between itself and this one
    inner = phrases.filter(size > 2).select("tree", F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a")
    within = inner.groupBy("tree", "ids").agg(F.max("a").alias("longer"))
    own = phrases.join(within, ["tree", "ids"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    counts = phrases.unionByName(words.select("tree", F.array("id").alias("ids"), F.col("f").alias("a")))
    counts = small(written(counts, "phrase-counts"))
    cuts = own.select("tree", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    of = lambda ids, count: counts.select("tree", F.col("ids").alias(ids), F.col("a").alias(count))
    cuts = cuts.join(of("head", "l"), ["tree", "head"]).join(of("tail", "r"), ["tree", "tail"]).join(small(langs.select("tree", "lang", "n")), "tree")
    weighed = F.lit(SCALE).cast("decimal(4,0)") * (_exact("a") * _exact("n"))
    cuts = cuts.withColumns({"weighed": weighed.cast("decimal(38,0)"), "chance": (_exact("l") * _exact("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("weighed div chance"))
    scored = cuts.groupBy("tree", "ids").agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("s")).select("tree", "ids", "s.*")
    first = scored.withColumn("place", F.rank().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top)
    spoken = first.select("tree", "ids", F.posexplode("ids").alias("at", "id")).join(small(words.select("tree", "id", "word")), ["tree", "id"])
    spoken = spoken.groupBy("tree", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = first.join(spoken, ["tree", "ids"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
