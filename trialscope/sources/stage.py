"""Intermediate results as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may fall back to a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    place = tempfile.mkdtemp(prefix="trialscope-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once: what follows reads it instead of computing it again, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task that works on them in Python.
ROWS_OF_PYTHON = 5_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over tasks whose number follows its rows: for work in Python on rows that may come from one small
    file, which one task reads. Counting reads no columns of a table."""
    return df.repartition(max(1, -(-df.count() // ROWS_OF_PYTHON)))


def dealt(df: DataFrame, *keys: str, rows_a_task: int = 500_000) -> DataFrame:
    """df by keys, over more parts than the session's if its rows ask for it: windows and aggregates by the keys then
    shuffle no more, and what a task holds stays the same however large the table is."""
    parts = -(-df.count() // rows_a_task)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' place (from 0) by order, as the column `name`, staged. Rows are dealt by range and sorted within
    their task, which numbers its own; only the tasks' counts are summed in one place, a row each."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("_part", before.alias("_before")))  # a row a task
    return placed.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*df.columns, name)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
