"""What the corpus operators share: written tables, checked broadcasts and packed columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast, as _bytes reckons them; beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a Python worker takes at once: less than these beside one text, which may be longer.
TEXT_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    place = tempfile.mkdtemp(prefix="trialscope-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written, in as many buckets of key as a shuffle has partitions: a later grouping by key moves no row."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/{table}").bucketBy(buckets, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets it; found and the files stay
    return found


def _bytes(df: DataFrame) -> Column:
    """What a row takes, about: 16 bytes and 8 a column, and the contents of strings and lists."""
    of = F.lit(16 + 8 * len(df.columns))
    for column, kind in df.dtypes:
        if kind in ("string", "binary"):
            of = of + F.coalesce(F.octet_length(f"`{column}`"), F.lit(0))
        elif kind.startswith("array"):
            of = of + 32 * F.coalesce(F.size(f"`{column}`"), F.lit(0))
    return of.cast("long")


def size_of(side: DataFrame) -> int:
    """Bytes of all rows, as _bytes reckons them."""
    return side.agg(F.sum(_bytes(side))).first()[0] or 0


def small(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """side marked for broadcast if a count proves it within the bound, else as it is (the join then shuffles)."""
    return F.broadcast(side) if size_of(side) <= most else side


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def sha_of_text(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: other columns cannot clash with them."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (Spark tells no case apart)."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by their bytes of text, or by the entries of a list column: Spark cuts by rows alone, and what a worker once took it holds until it ends."""
    for batch in batches:
        cells = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(cells.type) else pc.binary_length
        sizes = pc.fill_null(length(cells), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def give_back() -> None:
    """What Arrow's and the C library's allocators hold unused goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """run, a function for mapInArrow, returning what a worker has freed at the end of each task: Spark keeps idle workers,
    and what their allocators hold would add up with the next stage's."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of applyInArrow, after each group."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return group


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values by byte planes, compressed: high bytes that seldom change cost almost nothing."""
    values = np.ascontiguousarray(values)
    raw = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unplanes(blob: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel() if raw else np.empty(0, dtype)


def packed_words(words: list[str]) -> bytes:
    """A list of strings, compressed: their lengths, then their characters."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, raw), np.uint32, len(raw))
    head = planes(lengths)
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def words_of(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:4], "little")
    ends = np.cumsum(unplanes(blob[4 : 4 + n], np.uint32), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob[4 + n :]) if ends and ends[-1] else b""
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def ranked(df: DataFrame, group: str, *order: str, name: str = "ranked") -> DataFrame:
    """df with its rows' place by order within their group (rank, from 0), the group's rows (n) and a number that orders
    the groups (tree; nulls first). Ties stand in any order.

    Rows are dealt by range over group and order, so a large group spreads over tasks, and equal rows are told apart by
    where they were read. A task's rows lie in order; the counts of its groups, a row each, give where they begin.
    """
    row, at, part = fresh(df, "row"), fresh(df, "at"), fresh(df, "part")
    by = [F.col(f"`{c}`") for c in dict.fromkeys((group, *order))]
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*by, F.col(row)).sortWithinPartitions(*by, F.col(row)).drop(row)
    placed = written(dealt.withColumn(at, F.monotonically_increasing_id()), name).withColumn(part, F.shiftright(F.col(at), 33))
    first, key = fresh(df, "first"), fresh(df, "key")
    spans = placed.groupBy(F.col(part).alias(part), F.col(f"`{group}`").alias(key)).agg(F.count("*").alias("rows"), F.min(at).alias(first))
    same = Window.partitionBy(key)
    before = F.coalesce(F.sum("rows").over(same.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select(F.col(part), F.col(key), F.col(first), before.alias("before"), F.sum("rows").over(same).alias("n"), F.min(first).over(same).alias("tree")), f"{name}-spans")
    spans = small(spans.withColumnRenamed(part, f"{part}2"))
    joined = placed.join(spans, (placed[part] == spans[f"{part}2"]) & placed[group].eqNullSafe(spans[key]))
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], "tree", "n", (F.col("before") + F.col(at) - F.col(first)).alias("rank"))
