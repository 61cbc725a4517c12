"""Review queues: duplicates, unknown traces, fingerprints, text chunks and heartbeats."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_ids(ideas: DataFrame) -> DataFrame:
    return ideas.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def cross_file_duplicates(ideas: DataFrame) -> DataFrame:
    """Ids in more than one file, with the number of these and their sorted list. Only ids of several files are gathered."""
    once = ideas.select("id", "file").distinct()
    several = once.groupBy("id").agg(F.count("*").alias("n_files")).filter("n_files > 1")
    return once.join(several, "id").groupBy("id", "n_files").agg(F.array_sort(F.collect_list("file")).alias("files"))


def unknown_traces(ideas: DataFrame, traces: DataFrame) -> DataFrame:
    wanted = ideas.select(F.explode("trace_ids").alias("trace_id")).distinct()
    return wanted.join(traces.select("trace_id"), "trace_id", "left_anti")


@F.pandas_udf(T.StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and full case folding, which Spark has no function for."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fingerprint(*parts: Column, fold=folded) -> Column:
    """sha256: and the digest of the normalised parts as a JSON array. For ASCII text pass fold=F.lower: no Python."""
    normal = [squeezed(fold(p)) for p in parts]
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(F.to_json(F.array(*normal)), "UTF-8"), 256))


def chunks(texts: DataFrame, key: str, text: str, size: int = 5000, overlap: int = 500) -> DataFrame:
    """Overlapping pieces that cover a text."""
    stride = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    return texts.filter(F.col(text).isNotNull()).select(key, n.alias("n"), text, F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(key, F.col("piece").cast("long").alias("piece"), (F.col("piece") * stride).cast("long").alias("start"), F.substring(text, F.col("piece") * stride + 1, F.lit(size)).alias("chunk"))


def heartbeats(beats: DataFrame, every_s: float = 10.0) -> DataFrame:
    """The first beat of each interval after the first, per (nodeid, started)."""
    slot = F.floor((F.col("at") - F.col("started")) / F.lit(every_s))
    return beats.withColumn("slot", slot).filter("slot >= 1").groupBy("nodeid", "started", "slot").agg(F.min("at").alias("at"))


def expired(trials: DataFrame, now: Column) -> DataFrame:
    return trials.filter(now - F.col("started") >= F.col("timeout_s"))


def earliest_deadline(trials: DataFrame) -> DataFrame:
    deadline = F.col("started") + F.col("timeout_s")
    return trials.agg(F.min_by(F.struct(*trials.columns), deadline).alias("t")).select("t.*")


def timeout_failure(phase: Column, operation: Column) -> Column:
    """Category of a timeout: the harness's in setup and teardown, else the owner's of the open operation (judge, or a
    simulator's response), else the agent's."""
    return F.when(phase.isin("setup", "teardown"), "harness").when(operation == "simulator", "simulator").when(operation == "judge", "judge").otherwise("agent")


def timeout_kind(phase: Column) -> Column:
    return F.when(phase.isin("setup", "teardown"), phase).otherwise("timeout")


def open_operation(events: DataFrame) -> DataFrame:
    """The latest operation of each node that was started and not ended. An end closes the latest open start of its
    name, so what is still open began where the name's depth last rose to its final value."""
    step = F.when(F.col("event") == "start", 1).otherwise(-1)
    own = Window.partitionBy("nodeid", "operation")
    e = events.withColumns({"depth": F.sum(step).over(own.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), "last": F.sum(step).over(own)})
    began = e.filter("event = 'start' and last > 0 and depth = last")
    return began.groupBy("nodeid").agg(F.max_by("operation", "ord").alias("operation"))


def elapsed_ms(now: Column, started: Column, call_started: Column, phase: Column) -> Column:
    """Milliseconds since the call began, in its phase, else since the trial did; never negative."""
    since = F.when((phase == "call") & call_started.isNotNull(), call_started).otherwise(started)
    return F.greatest(F.lit(0.0), (now - since) / F.lit(1e6))


def timed_out(active: DataFrame, stored: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Trials that timed out, joined to what is known of them: a control snapshot of the node, else its stored trial,
    else nothing but the active row. active: nodeid, message, failure; the others: nodeid and payload columns."""
    payload = [c for c in stored.columns if c != "nodeid"]
    side = lambda df, name: df.select("nodeid", F.struct(*payload).alias(name))
    j = active.join(side(stored, "stored"), "nodeid", "left").join(side(snapshots, "snapshot"), "nodeid", "left")
    known = F.coalesce("snapshot", "stored")
    return j.select(*active.columns, known.isNotNull().alias("known"), *(known[c].alias(c) for c in payload), F.lit("error").alias("status"), F.lit(True).alias("incomplete"))


def prefix_matches(modules: DataFrame, registry: DataFrame) -> DataFrame:
    """Modules that are a registered root or lie below it: an equi-join on the module's dotted prefixes, no theta join."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return modules.select("module", F.explode(prefixes).alias("root")).join(registry, "root")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated")
    return j.withColumn("change", change).filter("change is not null").select("path", "change")
