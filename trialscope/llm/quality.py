"""Quality rules with host verdicts.

Each document gets its own counts; its failures are summed by host, each host's rate is shrunk towards the corpus by an
empirical beta prior, and hosts whose rate is high beyond doubt reject all their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, fresh, frugal, slices, small, written

MIN_WORDS = 20
WINDOW = 8
#: A host is rejected if its shrunk failure rate, less so many standard deviations, is above MAX_RATE.
MAX_RATE, SURE = 0.6, 2.0

_SYMBOLS = r"[#*$%&|<>]"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs and for those alone."""
    return pd.factorize(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second)[0]


def _hashes(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits of each window of words and its document."""
    factors = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, WINDOW + 1, np.uint64) * np.array(2, np.uint64) + np.array(1, np.uint64)
    mixed = (word.astype(np.uint64) + np.array(1, np.uint64)) * factors[-1]
    mixed ^= mixed >> np.array(29, np.uint64)
    m = max(len(word) - WINDOW + 1, 0)
    out = doc[:m].astype(np.uint64) * factors[-1]
    for k in range(WINDOW):
        out += mixed[k : k + m] * factors[k]
    return out


def _repeated_words(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """By document, how many words lie in windows of WINDOW words found twice or more in the document. Windows whose hash
    is found once are not; the others are numbered word by word."""
    hashes = _hashes(doc, word)
    at = np.flatnonzero(doc[: len(hashes)] == doc[len(doc) - len(hashes) :])
    order = at[np.argsort(hashes[at])]
    same = hashes[order[1:]] == hashes[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    key = doc[order]
    for k in range(WINDOW):
        key = _numbered(key, word[order + k])
    start = order[np.bincount(key, minlength=1)[key] > 1]
    begun = np.bincount(start, minlength=len(doc) + WINDOW + 1)
    begun[WINDOW:] -= np.bincount(start, minlength=len(doc) + 1)[: len(doc) + 1]
    return np.bincount(doc[np.cumsum(begun[: len(doc)]) > 0], minlength=n)


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """The base counts of texts, in the order of _COUNTS. Words are runs of anything but ASCII white space; a null text
    has none. All texts of an array are counted together, with some tens of bytes a word."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")

    def flat(lists: pa.LargeListArray | pa.ListArray, keep: Callable) -> tuple[np.ndarray, pa.DictionaryArray]:
        doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        values = lists.flatten()
        kept = keep(values)
        return doc[kept.to_numpy(zero_copy_only=False)], values.filter(kept).dictionary_encode()

    full = lambda values: pc.greater(pc.binary_length(values), 0)
    doc, words = flat(pc.ascii_split_whitespace(texts), full)
    word = words.indices.to_numpy().astype(np.int64)
    chars = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)[word] if len(word) else word
    line_doc, lines = flat(pc.split_pattern(texts, "\n"), lambda values: full(pc.ascii_trim_whitespace(values)))
    line = lines.indices.to_numpy().astype(np.int64)
    distinct = line_doc[~pd.Series(line_doc * (len(lines.dictionary) + 1) + line).duplicated().to_numpy()]
    by = lambda d: np.bincount(d, minlength=n)
    return [by(doc), np.bincount(doc, weights=chars, minlength=n).astype(np.int64), pc.count_substring_regex(texts, pattern=_SYMBOLS).to_numpy(zero_copy_only=False), by(line_doc) - by(distinct), _repeated_words(doc, word, n)]


def counts(text: str) -> tuple[int, int, int, int, int]:
    """The same of one text."""
    return tuple(int(c[0]) for c in counts_of(pa.array([text], pa.string())))


@frugal
def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns = [pa.array(c, pa.int64()) for c in counts_of(batch.column("text"))]
        own = ["doc_id", "host", "a", "b"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), *columns], [*own, *_COUNTS])


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate, host_failed. The prior is the beta whose mean and variance the hosts' rates have."""
    hosts = written(measured.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")), "hosts")
    raw = F.col("failed") / F.col("n")
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("h"), F.sum(F.col("n") * raw * raw).alias("s2")).first()
    mean = (m["f"] or 0) / m["n"] if m["n"] else 0.0
    if m["h"] and m["h"] > 1 and 0 < mean < 1:
        within = mean * (1 - mean)
        between = max(m["s2"] / m["n"] - mean * mean - within * m["h"] / m["n"], 1e-9)
        weight = min(max(within / between - 1, 1.0), 10_000.0)
    else:
        weight = 1.0
    a, b = max(mean, 1e-6) * weight, max(1 - mean, 1e-6) * weight
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    out = hosts.withColumn("rate", rate)
    doubt = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(a + b + 1)))
    return out.withColumn("host_failed", F.col("rate") - F.lit(SURE) * doubt > F.lit(MAX_RATE))


def _text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """What quality returns, with host and 128 bits of the text (a, b): the verdict depends on these alone."""
    own = fields(docs, doc_id=id_col, text=text_col, host=host_col).withColumn("host", F.col("host").cast("string"))
    own = own.withColumns(dict(zip("ab", _text_key(F.col("text")), strict=True)))
    kind = dict(own.dtypes)["doc_id"]
    d = own.mapInArrow(_count_batches, f"doc_id {kind}, host string, a long, b long, " + ", ".join(f"{c} long" for c in _COUNTS))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = written(d, "measured")
    verdicts = small(written(host_verdicts(d).filter("host_failed").select("host", "host_failed"), "verdicts"))
    out = d.join(verdicts, "host", "left")
    return out.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), "host", "a", "b")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept.

    A null or empty text has no words and fails. A row without a host has only its own verdict. Repeated rows count
    each, and long texts are counted whole. An empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, host_col).drop("host", "a", "b")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs that keep their place, all columns as they are. Each row has its own verdict, also where ids are null or
    repeated: a verdict is known by id, host and text."""
    names = {c: fresh(docs, c) for c in ("doc_id", "host", "a", "b")}
    gone = _judged(docs, id_col, text_col, host_col).filter("not kept").select(*names).distinct().withColumnsRenamed(names)
    gone = small(written(gone, "rejected"))
    own = (F.col(f"`{id_col}`"), F.col(f"`{host_col}`").cast("string"), *_text_key(F.col(f"`{text_col}`")))
    same = [x.eqNullSafe(gone[n]) for x, n in zip(own, names.values(), strict=True)]
    return docs.join(gone, same, "left_anti")
