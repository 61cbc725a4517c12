"""Reports, listings and live views over small rows."""

import datetime as dt

from pyspark.sql import functions as F

from trialscope.functions import expr
from trialscope.operators import contracts, queues, scoring, traces
from trialscope.sources import artifacts
from trialscope.streaming import live


def test_report(spark):
    rows = [("g1", "c1", 1, 2, "pass", None), ("g1", "c1", 2, 2, "pass", None), ("g2", "c2", 1, 2, "pass", None), ("g2", "c2", 2, 2, "fail", "assertion")]
    t = spark.createDataFrame(rows, "group_id string, case_id string, trial_index long, configured_trials long, status string, failure_kind string")
    t = t.withColumns({"failure_category": F.when(F.col("status") == "fail", "agent"), "smoke": F.lit(False), "duration_ms": F.lit(10.0), "cost_usd": F.lit(0.5), "llm_turns": F.lit(2.0)})
    text = artifacts.report(scoring.run_summary(t), scoring.verdicts(t))
    assert "| 1 | 0.750 | 2 |" in text and "| 2 | 0.500 | 2 |" in text and "- g2: flaky (1/2)" in text and "g1:" not in text and "- total_cost_usd: 2.0" in text


def test_latest_file(spark, tmp_path):
    import os

    for i, name in enumerate(("b", "a", "c")):
        (tmp_path / f"{name}.json").write_text("{}")
        os.utime(tmp_path / f"{name}.json", (1000 + i, 1000 + i))
    assert artifacts.latest_path(spark, str(tmp_path / "*.json")).endswith("c.json")


def test_timeout_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [("slow", at(0), "start"), ("quick", at(1), "start"), ("quick", at(30), "end"), ("late", at(2), "start"), ("late", at(900), "end"), ("now", at(5000), "start"), ("now", at(5001), "end")]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, "nodeid string, ts timestamp, event string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("nodeid string, ts timestamp, event string").parquet(source)
    q = live.timeouts(stream).writeStream.format("memory").queryName("timed_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.nodeid for r in spark.table("timed_out").collect()} == {"slow", "late"}


def test_open_operations_across_batches(spark, tmp_path):
    rows = [("n", 1, "a", "start"), ("n", 2, "b", "start"), ("n", 3, "b", "start"), ("n", 4, "b", "end"), ("n", 5, "b", "end"), ("m", 6, "x", "start"), ("m", 7, "x", "end"), ("m", 8, "y", "end")]
    df = spark.createDataFrame(rows, "nodeid string, ord long, operation string, event string")
    source = str(tmp_path / "ops")
    for k in (3, 4, 5, 8):
        df.filter((F.col("ord") <= k) & (F.col("ord") > {3: 0, 4: 3, 5: 4, 8: 5}[k])).coalesce(1).write.mode("append").parquet(source)
    seen = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = live.open_operations(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend((n, r.nodeid, r.operation) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [(0, "n", "b"), (1, "n", "b"), (2, "n", "a"), (3, "m", None)]
    assert {(r.nodeid, r.operation) for r in queues.open_operation(df.filter("ord < 8")).collect()} == {("n", "a")}


def test_small_rules(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(queues.timeout_failure(F.lit("call"), F.lit("judge"))) == "judge" and one(queues.timeout_failure(F.lit("setup"), F.lit("judge"))) == "harness"
    assert one(expr.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32"))) and not one(expr.iban_valid(F.lit("GB82WEST12345698765431")))
    assert one(expr.cut_text(F.lit("x" * 70))) == "x" * 63 + "…" and one(expr.int_of(F.lit(" 12 "))) == 12 and one(expr.int_of(F.lit("1.5"))) is None
    calls = spark.createDataFrame([("t", "find", "ok", 0)], "trace_id string, tool string, status string, sequence long")
    assert traces.called(calls, "find", status="error").first().called is False and traces.called(calls, "find").first().called is True
    checks = contracts.assertions(calls, {"null": F.lit(None).cast("boolean"), "yes": F.col("tool") == "find"})
    assert {(r.check, r.passed) for r in checks.collect()} == {("null", False), ("yes", True)}


def test_names_by_list_and_by_aggregate(spark):
    rows = [("t", "a", 0), ("t", "b", 1), ("u", "a", 0), ("u", "a", 1), ("v", "c", 0)]
    calls = spark.createDataFrame(rows, "trace_id string, tool string, sequence long")
    for wanted, banned in (([], []), (["a"], ["b"]), (["a", "b"], ["c"]), (["a", "a"], ["x"])):
        n = F.col("names")
        lists = traces.tool_names(calls).select("trace_id", traces.include(n, wanted), traces.exclude(n, banned), traces.no_repeats(n))
        assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, traces.tool_checks(calls, wanted, banned).collect()))
