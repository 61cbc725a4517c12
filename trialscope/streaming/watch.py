"""Trials watched by timers: a trial that has not ended at its deadline fails, in the class that its phase and its open
operation at that moment give it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trialscope.operators import queues

#: Milliseconds of event time after which what is known of a node that never started is forgotten.
FORGET_MS = 24 * 3600 * 1000
OUT = "nodeid string, started timestamp, deadline timestamp, phase string, operation string, category string, kind string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_of(events: list[tuple[str, str | None, str | None]]) -> tuple[str, str | None]:
    """The phase and the latest open operation after events (event, phase, operation) in order. An end of an operation
    closes the latest open start of its name; one without a start is ignored."""
    phase, open_ = "setup", []
    for event, new, operation in events:
        if event == "phase":
            phase = new or phase
        elif event == "open":
            open_.append(operation)
        elif event == "close" and operation in open_:
            del open_[len(open_) - 1 - open_[::-1].index(operation)]
    return phase, open_[-1] if open_ else None


def failure_of(phase: str, operation: str | None) -> tuple[str, str]:
    """Category and kind of a timeout, as timeout_failure and timeout_kind give them."""
    if phase in ("setup", "teardown"):
        return "harness", phase
    return (operation if operation in ("simulator", "judge") else "agent"), "timeout"


class Watch(StatefulProcessor):
    """State of a node: a value with start, timeout and end, and the list of its other events, to which a batch only adds.
    It goes when the trial ends in time, when it times out, or by a timer of its own if the trial never starts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trial = handle.getValueState("trial", "started long, timeout_us long, ended long")
        self.events = handle.getListState("events", "ts long, ord long, event string, phase string, operation string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, timeout, ended = self.trial.get() if self.trial.exists() else (None, None, None)
        own, new, last = [], False, 0
        for r in rows:
            ts = _micros(r.ts)
            last = max(last, ts)
            if r.event == "start" and (started is None or ts < started):
                started, timeout, new = ts, int(r.timeout_s * 1_000_000), True
            elif r.event == "end":
                ended = ts if ended is None else min(ended, ts)
            elif r.event in ("phase", "open", "close"):
                own.append((ts, r.ord, r.event, r.phase, r.operation))
        if started is not None and ended is not None and ended < started + timeout:
            self._forget()
            return iter(())
        self.trial.update((started, timeout, ended))
        if own:
            self.events.appendList(own)
        if new:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-(started + timeout) // 1000))
        elif started is None:
            self.handle.registerTimer(last // 1000 + FORGET_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started, timeout, ended = self.trial.get() if self.trial.exists() else (None, None, None)
        if started is None:
            self._forget()
            return iter(())
        deadline = started + timeout
        known = (tuple(x) for x in self.events.get()) if self.events.exists() else ()
        before = sorted((e for e in known if e[0] < deadline), key=lambda e: (e[1], e[0]))
        phase, operation = state_of([e[2:] for e in before])
        self._forget()
        category, kind = failure_of(phase, operation)
        return iter([Row(nodeid=str(key[0]), started=_moment(started), deadline=_moment(deadline), phase=phase, operation=operation, category=category, kind=kind)])

    def _forget(self) -> None:
        self.trial.clear()
        self.events.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


def _micros(ts: dt.datetime) -> int:
    """Microseconds of a moment; one without a zone is local, as the worker got it."""
    return int(ts.astimezone(dt.UTC).replace(microsecond=0).timestamp()) * 1_000_000 + ts.microsecond


def _moment(micros: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(micros // 1_000_000).replace(microsecond=micros % 1_000_000)


def timeouts(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """The trials of a stream that time out, each once, when the watermark passes its deadline. events: nodeid, ts, ord,
    event (start, phase, open, close or end), phase, operation, timeout_s (of a start); in any order within the watermark.

    An end before the deadline is in time. Events from the deadline on say nothing; those before it are taken in the
    order of ord. The stream wants RocksDB for its state
    (`rocksdb`).
    """
    e = events.select(F.col("nodeid").cast("string").alias("nodeid"), "ts", F.col("ord").cast("long").alias("ord"), "event", "phase", "operation", F.col("timeout_s").cast("double").alias("timeout_s"))
    schema = T.StructType.fromDDL(OUT)
    return e.withWatermark("ts", late).groupBy("nodeid").transformWithState(Watch(), schema, "append", "eventTime")


def timed_out(events: DataFrame, now) -> DataFrame:
    """The batch twin: the trials whose deadline has passed by `now` (a column) and that had not ended by then."""
    starts = events.filter("event = 'start'").groupBy("nodeid").agg(F.min(F.struct("ts", "timeout_s")).alias("s")).select("nodeid", F.col("s.ts").alias("started"), (F.col("s.ts") + F.make_dt_interval(secs=F.col("s.timeout_s").cast("decimal(18,6)"))).alias("deadline"))
    ends = events.filter("event = 'end'").groupBy("nodeid").agg(F.min("ts").alias("ended"))
    lost = starts.join(ends, "nodeid", "left").filter((F.col("ended").isNull() | (F.col("ended") >= F.col("deadline"))) & (F.col("deadline") < now)).drop("ended")
    before = events.join(lost.select("nodeid", "deadline"), "nodeid").filter(F.col("ts") < F.col("deadline"))
    phases = before.filter("event = 'phase' and phase is not null").groupBy("nodeid").agg(F.max_by("phase", F.struct("ord", "ts")).alias("phase"))
    own = Window.partitionBy("nodeid", "operation")
    step = F.when(F.col("event") == "open", 1).otherwise(-1)
    o = before.filter("event in ('open', 'close')").withColumn("total", F.sum(step).over(own.orderBy("ord", "ts").rowsBetween(Window.unboundedPreceding, 0)))
    # an end without a start is ignored: depth is counted from the lowest total so far
    o = o.withColumn("depth", F.col("total") - F.least(F.lit(0), F.min("total").over(own.orderBy("ord", "ts").rowsBetween(Window.unboundedPreceding, 0))))
    o = o.withColumn("last", F.max_by("depth", F.struct("ord", "ts")).over(own))
    began = o.filter("event = 'open' and last > 0 and depth = last").groupBy("nodeid").agg(F.max_by("operation", F.struct("ord", "ts")).alias("operation"))
    # of each name the last start to its final depth is the one still open; of all names the latest
    d = lost.join(phases, "nodeid", "left").join(began, "nodeid", "left").withColumn("phase", F.coalesce("phase", F.lit("setup")))
    return d.select(F.col("nodeid").cast("string").alias("nodeid"), "started", "deadline", "phase", "operation", queues.timeout_failure(F.col("phase"), F.col("operation")).alias("category"), queues.timeout_kind(F.col("phase")).alias("kind"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
