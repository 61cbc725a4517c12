"""Structured Streaming forms of the live views: each ends in the same rows as its batch twin on a finished stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trialscope.sources import versions


def trace_sessions(spans: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Traces as sessions of their spans (trace_id, ts, status): emitted once no span came for `gap`; spans later than
    the watermark are dropped."""
    s = spans.withWatermark("ts", late).groupBy("trace_id", F.session_window("ts", gap).alias("session"))
    out = s.agg(F.count("*").alias("span_count"), F.count_if(F.col("status") == "error").cast("long").alias("errors"))
    return out.select("trace_id", F.col("session.start").alias("started"), F.col("session.end").alias("closed"), "span_count", "errors")


def heartbeats(beats: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """One beat per node and interval."""
    slotted = beats.withWatermark("ts", late).withColumn("slot", F.window("ts", every)["start"])
    return slotted.dropDuplicatesWithinWatermark(["nodeid", "slot"]).select("nodeid", "slot")


def timeouts(events: DataFrame, timeout: str = "300 seconds", late: str = "1 minute") -> DataFrame:
    """Trials (nodeid, ts, event start or end) that were started and did not end within the timeout: the start joined
    to its end by an interval outer join, so state is kept for the timeout only."""
    e = events.withWatermark("ts", late)
    starts = e.filter("event = 'start'").select("nodeid", F.col("ts").alias("started"))
    ends = e.filter("event = 'end'").select(F.col("nodeid").alias("end_node"), F.col("ts").alias("ended"))
    within = F.expr(f"nodeid = end_node and ended >= started and ended <= started + interval {timeout}")
    return starts.join(ends, within, "left_outer").filter("ended is null").select("nodeid", "started")


def open_operations(events: DataFrame) -> DataFrame:
    """The latest open operation of each node (nodeid, ord, operation, event start or end), as a running view for update
    mode: the stack of open operations is the node's state. Ends come after their starts; an end without one is ignored.
    A node's events of a batch are taken in the order of ord."""

    def step(key, batches, state):
        stack = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ord")
        for event, operation in zip(rows["event"], rows["operation"], strict=True):
            if event == "start":
                stack.append(operation)
            elif operation in stack:
                del stack[len(stack) - 1 - stack[::-1].index(operation)]
        if stack:
            state.update((stack,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"nodeid": [str(key[0])], "operation": [stack[-1] if stack else None]})

    return events.groupBy("nodeid").applyInPandasWithState(step, "nodeid string, operation string", "open array<string>", "update", GroupStateTimeout.NoTimeout)


def verdict_counts(trials: DataFrame) -> DataFrame:
    """Running counts per group, for complete or update mode."""
    count = lambda s: F.count_if(F.col("status") == s).cast("long").alias(s)
    return trials.groupBy("group_id").agg(F.count("*").alias("total"), *map(count, ("pass", "fail", "error")))


def upsert(path: str, key: str = "nodeid", order: str = "ord", parts: int = 64, source: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the latest row of each key, in a versioned table of `parts` parts by the key's hash. A batch
    writes anew the parts that its keys are in and commits them as one version; a batch of this source that comes again
    is not applied. latest_rows reads the table, during a batch the version before it."""

    def run(batch: DataFrame, number: int) -> None:
        versions.upsert(batch.sparkSession, path, batch, key, order, parts, (source, number))

    return run


def latest_rows(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return versions.read(spark, path, at=number)
