import datetime as dt

import pytest
from pyspark.sql import functions as F

from trialscope.streaming import watch

START = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC).replace(tzinfo=None)
SCHEMA = "nodeid string, ts timestamp, ord long, event string, phase string, operation string, timeout_s double"


def at(node, s, event, phase=None, operation=None, timeout=None):
    return node, START + dt.timedelta(seconds=s), int(s), event, phase, operation, timeout


EVENTS = [
    *[e for n, p in (("a", "setup"), ("b", "call"), ("c", "teardown")) for e in (at(n, 0, "start", timeout=10.0), at(n, 1, "phase", p))],
    at("d", 0, "start", timeout=10.0), at("d", 1, "phase", "call"), at("d", 2, "open", operation="judge"), at("d", 3, "open", operation="llm"), at("d", 4, "close", operation="llm"),
    at("e", 0, "start", timeout=10.0), at("e", 1, "phase", "call"), at("e", 2, "open", operation="simulator"), at("e", 3, "close", operation="judge"), at("e", 11, "close", operation="simulator"),
    at("f", 0, "start", timeout=10.0), at("f", 9, "end"),
    at("g", 0, "start", timeout=10.0), at("g", 10, "end"),
    at("h", 5, "phase", "call"), at("h", 6, "open", operation="judge"),
    at("i", 0, "start", timeout=100000.0),
    at("z", 5000, "phase", "call"),
]
EXPECTED = {"a": ("setup", None, "harness", "setup"), "b": ("call", None, "agent", "timeout"), "c": ("teardown", None, "harness", "teardown"), "d": ("call", "judge", "judge", "timeout"), "e": ("call", "simulator", "simulator", "timeout"), "g": ("setup", None, "harness", "setup")}


def result(df):
    rows = df.collect()
    out = {r.nodeid: (r.phase, r.operation, r.category, r.kind) for r in rows}
    assert len(rows) == len(out)
    return out


def test_batch_twin(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert result(watch.timed_out(df, F.lit(START + dt.timedelta(hours=1)))) == EXPECTED
    assert result(watch.timed_out(df.limit(0), F.lit(START))) == {}


@pytest.mark.parametrize("order", [1, -1])
def test_stream_equals_its_batch_twin(spark, tmp_path, order):
    for i, part in enumerate((EVENTS[:-1][::order], EVENTS[-1:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    name = f"watched_{'down' if order < 0 else 'up'}"
    with watch.rocksdb(spark):
        q = watch.timeouts(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert result(spark.table(name)) == EXPECTED
