"""What showed on larger tables only: rare values, and work or memory of a task that grew faster than the input."""

import datetime as dt
import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from trialscope.functions import expr
from trialscope.operators import contracts, scoring
from trialscope.plans import catalog, checks, readings
from trialscope.sources import readers, stage
from trialscope.streaming import watch


def write_events(folder, rows):
    c = duckdb.connect()
    c.sql("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into e values (?, ?, ?, ?, 1.0, '{\"k\": 1}')", rows)
    c.sql(f"copy e to '{folder}/events.parquet'")
    return str(folder)


def test_a_trial_begins_at_the_nearest_second(spark, tmp_path):
    """As in the SQL: the last half second of three days belongs to the next trial; halves go to the even second."""
    at = dt.datetime(2024, 1, 3)
    while int((at - dt.datetime(1970, 1, 1)).total_seconds()) % 259200:
        at += dt.timedelta(days=1)
    micros = (-700_000, -500_001, -500_000, -499_999, -1, 0, 400_000)
    d = write_events(tmp_path, [(i, at + dt.timedelta(microseconds=m), 4 + 10 * i, "view") for i, m in enumerate(micros)])
    wanted = duckdb.sql(f"SELECT event_id, user_id || '.' || (epoch(ts)::BIGINT // 259200) FROM '{d}/events.parquet'").fetchall()
    got = readings.watched_events(spark, d).select("ord", "nodeid").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert len({n.split(".")[1] for _, n in wanted}) == 2


def test_events_before_a_deadline_count_in_the_order_of_ord(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start, 0, "start", None, 10.0), ("a", start + dt.timedelta(seconds=5), 1, "phase", "setup", None), ("a", start + dt.timedelta(seconds=3), 2, "phase", "call", None)]
    events = spark.createDataFrame(rows, "nodeid string, ts timestamp, ord long, event string, phase string, timeout_s double").withColumn("operation", F.lit(None).cast("string"))
    assert [r.phase for r in watch.timed_out(events, F.lit(start + dt.timedelta(hours=1))).collect()] == ["call"]


def tasks_of(spark, group, action):
    """The numbers of tasks of the stages that an action ran."""
    spark.sparkContext.setJobGroup(group, group)
    action()
    tracker = spark.sparkContext.statusTracker()
    stages = (tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)
    spark.sparkContext.setJobGroup("", "")
    return [s.numTasks for s in stages if s]


def write_customers(folder, n):
    duckdb.sql(f"copy (select range as c_custkey from range({n})) to '{folder}/customer.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["redacted_documents", "redacted_locators", "detected_types"])
def test_work_in_python_is_dealt_by_rows_not_by_files(spark, tmp_path, name, monkeypatch):
    """One small file is read by one task, which must not run the detectors for all of its rows."""
    monkeypatch.setattr(stage, "ROWS_OF_PYTHON", 20)
    d = write_customers(tmp_path, 400)
    assert max(tasks_of(spark, f"spread-{name}", catalog.queries()[name](spark, d).collect)) >= 20


def test_a_task_writes_and_reads_few_snapshots(spark, tmp_path, monkeypatch):
    duckdb.sql(f"copy (select range // 4 as l_orderkey, (range % 4)::int as l_linenumber, range as l_partkey from range(4000)) to '{tmp_path}/lineitem.parquet'")
    monkeypatch.setattr(readings, "SNAPSHOTS_A_FILE", 100)
    made = []
    monkeypatch.setattr(readings, "place", lambda s, name, place=readings.place: made.append(place(s, name)) or made[-1])
    got = {(r.nodeid, r.part) for r in readings.streamed_upserts(spark, str(tmp_path)).collect()}
    assert got == {(str(i), 4 * i + 3) for i in range(1000)}
    files = glob.glob(made[0].removeprefix("file:") + "/*.parquet")
    assert len(files) == 42  # three batches of fourteen files


def test_messages_and_aggregates_shuffle_once(spark, tmp_path):
    duckdb.sql(f"copy (select range // 4 as l_orderkey, (1 + range % 4)::int as l_linenumber from range(400)) to '{tmp_path}/lineitem.parquet'")
    plan = checks.message_contract(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_tables_are_dealt_over_more_parts(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert stage.dealt(df, "k", rows_a_task=10).rdd.getNumPartitions() == 100
    assert stage.dealt(df, "k", rows_a_task=1000).columns == df.columns


def test_answers_of_a_call_count_once(spark):
    rows = [("a", 0, "user", "hi", None, None), ("a", 1, "assistant", None, [("x",), ("y",), ("y",)], None), ("a", 2, "tool", "r", None, "x"), ("a", 3, "tool", "r", None, "x"), ("a", 4, "tool", "r", None, "z"), ("a", 5, "tool", "r", None, "z"), ("a", 6, "user", "hi", None, None), ("a", 7, "tool", "r", None, "x")]
    df = spark.createDataFrame(rows, "case_id string, turn long, role string, content string, tool_calls array<struct<id: string>>, tool_call_id string")
    got = sorted(tuple(r) for r in contracts.messages(df).collect())
    assert got == [("repeated tool call id", "a/1", "assistant"), ("tool call answered again", "a/3", "x"), ("tool call not answered", "a/1", "y"), ("unknown tool call id", "a/4", "z"), ("unknown tool call id", "a/5", "z"), ("unknown tool call id", "a/7", "x")]


def test_stored_aggregates_are_counted_once_a_side(spark):
    t = spark.createDataFrame([("g", 1, 1, "pass", None, False, "c")], "group_id string, trial_index long, configured_trials long, status string, failure_kind string, smoke boolean, case_id string")
    now = scoring.verdicts(t)
    found = contracts.derived_equal(t, now.unionByName(now).unionByName(now.withColumn("verdict", F.lit("stale"))))
    assert sorted(map(tuple, found.collect())) == [("aggregate not derived", "g", "pass"), ("aggregate not derived", "g", "stale")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by") == 4  # the trials are aggregated once for each side of the comparison, here four times in all


def test_objects_are_shredded_once(spark, tmp_path):
    """A check of each object isn't pushed below the shredding, nor are upper levels of an export written as JSON again."""
    (tmp_path / "a.jsonl").write_text('{"span_id":"1","trace_id":"t"}\n')
    rows = []
    keep = readers.json_spans
    try:
        readers.json_spans = lambda r, *a: rows.append(r) or keep(r, *a)
        readers.read(spark, "jsonl", str(tmp_path / "a.jsonl"))
    finally:
        readers.json_spans = keep
    plan = rows[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_numbers_of_texts(spark):
    texts = ["12", " 12 ", "\t-3\n", "", "x", "1.5", "1e3", "true", "inf", "NaN", "9223372036854775808", "+7", ".5", "5d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", expr.long_of(F.col("t")).eqNullSafe(F.col("t").try_cast("long")).alias("l"), expr.double_of(F.col("t")).eqNullSafe(F.col("t").try_cast("double")).alias("d")).collect()
    assert [r.t for r in got if not (r.l and r.d)] == []
