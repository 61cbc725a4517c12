"""The shared tables in the shapes of the trace and trial model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialscope.functions import expr, formats
from trialscope.sources.stage import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, from lineitem: one trial per row, a group per order."""
    li = dealt(table(spark, sf_dir, "lineitem").withColumn("group_id", F.col("l_orderkey").cast("string")), "group_id")
    rank = Window.partitionBy("group_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    group = Window.partitionBy("group_id")
    status = F.when(F.col("l_suppkey") % 11 == 0, "skipped").when((F.col("l_returnflag") == "N") | (F.col("l_partkey") % 2 == 0), "pass").when(F.col("l_returnflag") == "A", "fail").otherwise("error")
    category = F.when(status == "fail", "agent").when(status == "error", F.element_at(F.array(*map(F.lit, formats.CATEGORIES)), (F.col("l_suppkey") % 7).cast("int") + 1))
    return li.select(
        "group_id",
        F.row_number().over(rank).cast("long").alias("trial_index"),
        (F.count("*").over(group) + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).alias("configured_trials"),
        status.alias("status"),
        F.when(status.isin("fail", "error"), F.when(F.col("l_quantity") >= 48, "timeout").otherwise("execution")).alias("failure_kind"),
        category.alias("failure_category"),
        (F.col("l_orderkey") % 50 == 0).alias("smoke"),
        (F.col("l_quantity") * 10).alias("duration_ms"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / F.lit(1e6)).alias("cost_usd"),
        F.col("l_linenumber").cast("double").alias("llm_turns"),
    ).withColumns({"case_id": F.concat(F.lit("case-"), "group_id"), "nodeid": F.concat_ws("::", "group_id", F.col("trial_index").cast("string"))})


TRIALS_SQL = """
    trials AS (SELECT l_orderkey::VARCHAR AS group_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS trial_index,
        count(*) OVER (PARTITION BY l_orderkey) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS configured_trials, status,
        CASE WHEN status IN ('fail', 'error') THEN CASE WHEN l_quantity >= 48 THEN 'timeout' ELSE 'execution' END END AS failure_kind,
        CASE WHEN status = 'fail' THEN 'agent' WHEN status = 'error' THEN
            ['agent', 'simulator', 'judge', 'configuration', 'infrastructure', 'harness', 'unknown'][(l_suppkey % 7)::INT + 1] END AS failure_category,
        l_orderkey % 50 = 0 AS smoke, l_quantity * 10 AS duration_ms, CASE WHEN l_tax > 0 THEN l_extendedprice / 1e6::DOUBLE END AS cost_usd,
        l_linenumber::DOUBLE AS llm_turns, 'case-' || l_orderkey::VARCHAR AS case_id
        FROM (SELECT *, CASE WHEN l_suppkey % 11 = 0 THEN 'skipped' WHEN l_returnflag = 'N' OR l_partkey % 2 = 0 THEN 'pass' WHEN l_returnflag = 'A' THEN 'fail' ELSE 'error' END AS status FROM lineitem))
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """span rows, from events: a trace per user, in order of (start, id)."""
    e = table(spark, sf_dir, "events")
    start = expr.nanos_of_timestamp(F.col("ts"))
    kind = F.col("event_type")
    tool = F.when(kind.isin("click", "purchase"), kind)
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.col("event_type").alias("name"),
        F.when(kind == "view", "llm").otherwise(expr.kind_of(kind, tool)).alias("kind"),
        tool.alias("tool_name"),
        start.alias("started_at"),
        (start + (F.col("value") * F.lit(1e6)).cast("long")).alias("ended_at"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"),
        F.when(kind != "signup", F.col("value") / F.lit(1000.0)).alias("cost_usd"),
        "props",
    )


SPANS_SQL = """
    spans AS (SELECT user_id::VARCHAR AS trace_id, event_id AS span_id, event_type AS name,
        CASE WHEN event_type = 'view' THEN 'llm' WHEN event_type IN ('click', 'purchase') THEN 'tool' ELSE lower(event_type) END AS kind,
        CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS tool_name,
        trunc(epoch_us(ts) / 1e6::DOUBLE * 1e9::DOUBLE)::BIGINT AS started_at,
        trunc(epoch_us(ts) / 1e6::DOUBLE * 1e9::DOUBLE)::BIGINT + trunc(value * 1e6::DOUBLE)::BIGINT AS ended_at,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN event_type <> 'signup' THEN value / 1000.0::DOUBLE END AS cost_usd, props FROM events)
"""
