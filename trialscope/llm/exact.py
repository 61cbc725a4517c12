"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries type frequent-items sketch over the digests names every digest that may hold more than `share` of the
rows. Its candidates are counted exactly; the verified ones, at most 1 / share, are broadcast, so their copies are
settled where they are read. The other digests are aggregated with partial sums, so a group costs a row a task, and
only groups of two or more rows are joined back to theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, fresh, sha_of_text, small, text_of, written

#: Counters of a sketch (a power of two). It keeps every digest above 1 / (0.75 * COUNTERS) of its rows.
COUNTERS = 4096
#: A digest with at least this share of the rows is a heavy hitter; well above the sketch's error.
SHARE = 1 / 1000
#: Sketches are first merged in so many groups, so that no task merges those of all partitions.
FAN_IN = 64


def heavy_candidates(digests: DataFrame, share: float, counters: int = COUNTERS) -> DataFrame:
    """At most 1 / share digests, among them each one that has share of the rows."""
    top = int(1 / share)
    parts = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("sketch"))
    # by a constant key: without one, a task without rows would hand on a sketch without a type, which fails to merge
    items = parts.withColumn("all", F.lit(True)).groupBy("all").agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {counters}), {top})").alias("items"))
    return items.select(F.explode("items").alias("i")).select(F.col("i.item").alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal if identical. The row with the largest id stays; null ids sort below
    all others, and keep_id is null if a group has no id. Of repeated rows (same id and text) one stays. An empty
    table gives no rows; columns other than the two named are not read.
    """
    own = fields(docs, doc_id=id_col, text=text_col)
    d = written(own.select("doc_id", sha_of_text(text_of()).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    total = d.count()
    best = F.max(F.struct("doc_id", "row"))
    if total * share > 2:
        candidates = F.broadcast(heavy_candidates(d, share))
        heavy = d.join(candidates, "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).filter(F.col("group_size") >= total * share)
        heavy = F.broadcast(written(heavy, "heavy"))  # at most 1 / share rows
        settled = d.join(heavy, "digest")
        rest = d.join(heavy, "digest", "left_anti")
    else:
        settled, rest = None, d
    shared = rest.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    shared = small(written(shared, "shared-digests"))
    alone = F.struct("doc_id", "row")
    out = rest.join(shared, "digest", "left").withColumns({"best": F.coalesce("best", alone), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    if settled is not None:
        out = out.unionByName(settled)
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they are.

    The dropped (id, digest) pairs are broadcast if a count proves them few; else the join shuffles. Of rows repeated
    with the same id and text one stays, with the columns of any of them. No column of docs is renamed or overwritten.
    """
    groups = written(exact_groups(docs, id_col, text_col), "groups")
    id_, sha, kept = fresh(docs, "id"), fresh(docs, "sha"), fresh(docs, "kept")
    same = groups.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias(kept), F.count("*").alias("n"))
    same = written(same.filter(~F.col(kept) | (F.col("n") > 1)).drop("n"), "dropped")
    keyed = docs.withColumn(sha, sha_of_text(text_of(text_col)))
    on = lambda side: (F.col(f"`{id_col}`").eqNullSafe(side[id_])) & (keyed[sha] == side[sha])
    gone = small(same)
    once = keyed.join(gone, on(gone), "left_anti").drop(sha)
    repeated = same.filter(F.col(kept))
    if repeated.isEmpty():
        return once
    twice = small(repeated)
    return once.unionByName(keyed.join(twice, on(twice), "left_semi").dropDuplicates([id_col, sha]).drop(sha))
