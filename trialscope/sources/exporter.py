"""A run's raw spans, appended as they come, with counts that no append has to make again.

Each append reads its own rows. Their trace ids are held against a sketch of all ids before (a Bloom filter, as bitmaps
that merge by or): an id that the sketch doesn't have is new, the few that it may have are looked up in the exact sets of
ids, of which only the buckets that they fall in are read. Rows are committed before they can be seen; an append that
finds a committed one that its writer did not get to show shows it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.sources import versions
from trialscope.sources.stage import staged

#: Buckets of ids, bits of each bucket's filter, and places that an id has in it.
BUCKETS, FILTER_BITS, PROBES = 64, 1 << 19, 4
#: A raw artifact is never safe: raw spans become evidence by an import only.
RAW = {"raw_source": True, "mandatory": False, "value_redaction_applied": False, "redaction_available": False}


def _bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def _probes(ids: DataFrame) -> DataFrame:
    """id, bucket, and for each of its places in the bucket's filter the bitmap and the bit there."""
    places = F.array(*(F.pmod(F.xxhash64(F.lit(k + 1), "id"), F.lit(FILTER_BITS)) for k in range(PROBES)))
    d = ids.select("id", "bucket", F.explode(places).alias("place"))
    return d.select("id", "bucket", F.bitmap_bucket_number("place").alias("number"), F.bitmap_bit_position("place").alias("bit"))


def _bitmaps(probes: DataFrame) -> DataFrame:
    return probes.groupBy("bucket", "number").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def _show(spark: SparkSession, folder: str, known: versions.Version) -> None:
    """The last append takes its name, if its writer did not get that far. Those before it have theirs."""
    name = known.state.get("last")
    if name:
        hidden, fs = versions._hadoop(spark, f"{folder}/spans/.{name}")
        if fs.exists(hidden):
            fs.rename(hidden, versions._hadoop(spark, f"{folder}/spans/{name}")[0])


def append(spans: DataFrame, folder: str, run_id: str, batch: tuple[str, int] | None = None, trace_col: str = "trace_id") -> dict:
    """Adds raw spans to a run, as JSON below spans/, and returns its manifest. A null trace id is counted as a span, not as a trace; a batch
    that comes again adds nothing; an empty append adds only its commit."""
    spark, folder = spans.sparkSession, folder.rstrip("/")
    before = versions.version(spark, folder)
    if batch and before.batches.get(batch[0], -1) >= batch[1]:
        _show(spark, folder, before)
        return _manifest(spark, folder, before)
    name = f"append={uuid.uuid4().hex}"  # Spark reads no folder that begins with a dot
    place = f"{folder}/spans/.{name}"
    spans.write.json(place)
    own = spark.read.schema(f"`{trace_col}` string").json(place).select(F.col(f"`{trace_col}`").alias("id"))  # what was written, a column of it
    ids = staged(own.groupBy("id").agg(F.count("*").alias("spans")).withColumn("bucket", _bucket(F.col("id"))), "append-ids")
    count = ids.agg(F.coalesce(F.sum("spans"), F.lit(0)).alias("n")).first().n
    traces = ids.filter("id is not null").select("id", "bucket")
    probes = _probes(traces)

    def change(base: versions.Version) -> versions.Change:
        _show(spark, folder, base)
        new, sketch = traces, _bitmaps(probes)
        if "sketch" in base.schemas:
            stored = versions.read(spark, folder, "sketch", base)
            hit = probes.join(stored, ["bucket", "number"], "left").groupBy("id", "bucket").agg(F.bool_and(F.coalesce(_set(F.col("bitmap"), F.col("bit")), F.lit(False))).alias("maybe"))
            maybe = staged(hit.filter("maybe").select("id", "bucket"), "append-maybe")
            buckets = {str(r.bucket) for r in maybe.select("bucket").distinct().collect()}  # at most BUCKETS
            if buckets:
                parts = [p for p in base.members["ids"] if p.split(".")[0] in buckets]
                repeated = maybe.join(versions.read(spark, folder, "ids", base, parts), "id", "left_semi")
                new = traces.join(repeated.select("id"), "id", "left_anti")
            sketch = stored.unionByName(sketch).groupBy("bucket", "number").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        new = staged(new, "append-new")
        kept = versions.written(new, folder, "bucket")
        held = {"ids": {f"{b}.{name}": f for b, f in kept.items()}, "sketch": versions.written(sketch, folder)}
        state = {"run_id": run_id, "span_count": base.state.get("span_count", 0) + count, "trace_count": base.state.get("trace_count", 0) + new.count(), "last": name}
        return versions.Change(held, {"ids": new.drop("bucket").schema.json(), "sketch": sketch.schema.json()}, ("sketch",), state)

    after = versions.transact(spark, folder, change, batch)
    _show(spark, folder, after)
    return _manifest(spark, folder, after)


def _manifest(spark: SparkSession, folder: str, at: versions.Version) -> dict:
    counts = {k: at.state[k] for k in ("run_id", "span_count", "trace_count")}
    return counts | {"source": "local-jsonl", "files": ["spans"], "version": at.number, "created_at": dt.datetime.now(dt.UTC).isoformat(), "redaction": RAW, **RAW}


def manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a run's last version."""
    return _manifest(spark, folder, versions.version(spark, folder))
