"""Verdicts, reliability, cost and latency over trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions import expr, formats

SMOKE_CASE, SMOKE_NODE = "smoke", r".*::test_smoke(\[.*\])?"


def is_smoke(smoke: Column, case_id: Column, node_id: Column) -> Column:
    """The flag if set, else an exact case id or a full match of the node id."""
    return F.coalesce(smoke, (case_id == SMOKE_CASE) | node_id.rlike(f"^(?:{SMOKE_NODE})$"), F.lit(False))


def eligible(trials: DataFrame) -> DataFrame:
    """Trials that count towards reliability, cost and latency: no smoke tests, and of the errors only the agent's."""
    own = F.col("status").isin("pass", "fail") | ((F.col("status") == "error") & (F.col("failure_category") == "agent"))
    return trials.filter(~F.col("smoke") & own)


def verdicts(trials: DataFrame) -> DataFrame:
    """One row a group: counts and the verdict. A timeout outranks missing trials, those outrank errors. Groups whose
    trials were all skipped vanish. One shuffle, with partial aggregation."""
    ran = F.col("status") != "skipped"
    count = lambda c: F.count_if(c).cast("long")
    g = trials.groupBy("group_id").agg(
        F.min_by(F.when(ran, F.col("case_id")), F.when(ran, F.col("trial_index"))).alias("case_id"),
        F.max("configured_trials").alias("configured_trials"),
        count(ran).alias("total"),
        count(F.col("status") == "pass").alias("passed"),
        count(F.col("status") == "fail").alias("failed"),
        count(F.col("status") == "error").alias("errored"),
        count(~ran).alias("skipped"),
        F.bool_or(F.coalesce(ran & (F.col("failure_kind") == "timeout"), F.lit(False))).alias("timed_out"),
        F.bool_or("smoke").alias("smoke"),
    )
    g = g.filter("total > 0").withColumn("partial", F.col("total") + F.col("skipped") < F.col("configured_trials"))
    verdict = F.when(F.col("timed_out"), "error").when(F.col("partial"), "partial").when(F.col("errored") > 0, "error")
    verdict = verdict.when(F.col("passed") == F.col("total"), "pass").when(F.col("failed") == F.col("total"), "fail").otherwise("flaky")
    return g.withColumn("verdict", verdict).drop("timed_out")


def cohorts(trials: DataFrame) -> DataFrame:
    return eligible(trials).groupBy("group_id").agg(F.min_by("case_id", "trial_index").alias("case_id"), F.count_if(F.col("status") == "pass").cast("long").alias("passed"), F.count("*").alias("total"))


def pass_k_curve(groups: DataFrame) -> DataFrame:
    """For each k, the mean pass^k over the cohorts with at least k trials.

    Cohorts of the same (passed, total) are counted first, so the curve is computed over a handful of rows however many
    cohorts there are.
    """
    kinds = groups.groupBy("passed", "total").agg(F.count("*").alias("n"))
    points = kinds.select("passed", "total", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))).alias("k"))
    value = expr.pass_hat_k(F.col("passed"), F.col("total"), F.col("k"))
    return points.groupBy("k").agg((F.sum(value * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("cohorts"))


def latency(trials: DataFrame, ranges: int = 4096) -> DataFrame:
    """Exact median, nearest-rank p95 and mean of the durations; zeros if there are none.

    Durations are counted by range first, ranges of equal width between the least and the greatest. Their sums tell
    which ranges hold the ranks asked for; only the values of these are ranked, each range by itself.
    """
    d = trials.select(F.col("duration_ms").cast("double").alias("x")).filter("x is not null")
    low, high, n, total = d.agg(F.min("x"), F.max("x"), F.count("*"), F.sum("x")).first()
    zero = F.lit(0.0)
    if not n:
        return trials.sparkSession.range(1).select(zero.alias("latency_p50_ms"), zero.alias("latency_p95_ms"), zero.alias("latency_mean_ms"))
    width = (high - low) / ranges or 1.0
    cell = lambda x: F.least(F.lit(ranges - 1), F.floor((x - low) / F.lit(width)).cast("int"))
    counts = d.groupBy(cell(F.col("x")).alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()  # at most `ranges` rows
    ranks = [(n - 1) // 2, n // 2, round(0.95 * (n - 1))]
    wanted, before = {}, 0
    for r in counts:
        for rank in ranks:
            if before <= rank < before + r.n:
                wanted[rank] = (r.cell, rank - before)
        before += r.n
    cells = sorted({c for c, _ in wanted.values()})
    values = d.withColumn("cell", cell(F.col("x"))).filter(F.col("cell").isin(*cells)).groupBy("cell", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto)
    at = lambda rank: F.min(F.when((F.col("cell") == wanted[rank][0]) & (F.col("upto") > wanted[rank][1]), F.col("x")))
    out = ranked.agg(*(at(r).alias(f"r{i}") for i, r in enumerate(ranks)))
    return out.select(((F.col("r0") + F.col("r1")) / 2).alias("latency_p50_ms"), F.col("r2").alias("latency_p95_ms"), F.lit(total / n).alias("latency_mean_ms"))


def cost_observation(trials: DataFrame) -> DataFrame:
    """Adds relevant, complete and observed_cost. Needs the flag has_known_cost (whether the key was present), as null
    and absent differ; columns that are missing count as absent."""
    for name, kind in {"known_cost_usd": "double", "cost_available": "boolean", "has_known_cost": "boolean", "operation_kind": "string"}.items():
        if name not in trials.columns:
            trials = trials.withColumn(name, F.lit(None).cast(kind))
    cost, known, turns = expr.cost_of(F.col("cost_usd")), expr.cost_of(F.col("known_cost_usd")), expr.finite(F.col("llm_turns"))
    timed_out = F.coalesce((F.col("failure_kind") == "timeout") & (F.col("operation_kind") == "llm"), F.lit(False))
    yes, no = F.coalesce(F.col("cost_available"), F.lit(False)), F.coalesce(~F.col("cost_available"), F.lit(False))
    relevant = F.coalesce(turns > 0, F.lit(False)) | yes | known.isNotNull() | F.coalesce(cost != 0, F.lit(False)) | timed_out
    legacy = F.when(cost != 0, cost)
    present = F.coalesce("has_known_cost", F.lit(False))
    observed = F.when(~relevant, F.lit(None)).when(timed_out | yes, F.coalesce(known, cost)).when(no | present, known).otherwise(legacy)
    complete = F.when(~relevant | timed_out, F.lit(False)).when(yes, cost.isNotNull()).when(no | present, F.lit(False)).otherwise(legacy.isNotNull())
    return trials.withColumns({"relevant": relevant, "complete": complete, "observed_cost": observed.cast("double")})


def cost_summary(trials: DataFrame) -> DataFrame:
    t = cost_observation(trials)
    s = t.agg(
        F.coalesce(F.sum("observed_cost"), F.lit(0.0)).alias("known_cost_usd"),
        F.count_if("complete").cast("long").alias("cost_known_trials"),
        F.count_if("relevant").cast("long").alias("cost_relevant_trials"),
        F.count("observed_cost").alias("priced"),
        F.count_if(F.col("status") == "pass").cast("long").alias("passes"),
        F.coalesce(F.avg(expr.finite(F.col("llm_turns"))), F.lit(0.0)).alias("mean_llm_turns"),
    )
    complete = (F.col("cost_relevant_trials") > 0) & (F.col("cost_known_trials") == F.col("cost_relevant_trials"))
    total = F.when(complete, F.col("known_cost_usd"))
    return s.select(
        total.alias("total_cost_usd"),
        "known_cost_usd",
        F.when(F.col("passes") > 0, total / F.col("passes")).alias("cost_per_pass_usd"),
        "mean_llm_turns",
        "cost_known_trials",
        "cost_relevant_trials",
        F.when(F.col("cost_relevant_trials") > 0, F.col("cost_known_trials") / F.col("cost_relevant_trials")).otherwise(F.lit(0.0)).alias("cost_coverage"),
        (F.col("priced") > 0).alias("has_cost"),
        complete.alias("cost_complete"),
        ((F.col("priced") > 0) & ~complete).alias("cost_partial"),
    )


def error_counts(trials: DataFrame) -> DataFrame:
    """One row per category, zeros included."""
    errors = trials.filter((F.col("status") == "error") & ~F.col("smoke"))
    row = errors.agg(*(F.count_if(F.col("failure_category") == c).cast("long").alias(c) for c in formats.CATEGORIES))
    return row.unpivot([], list(formats.CATEGORIES), "category", "errors")


def excluded_errors(trials: DataFrame) -> DataFrame:
    agent = F.coalesce(F.col("failure_category") == "agent", F.lit(False))
    return trials.filter((F.col("status") == "error") & ~F.col("smoke") & ~agent).agg(F.count("*").alias("excluded_error_trials"))


SUMMARY_PARTS = ("pass_k_curve", "pass_k_cohorts", "error_counts", "excluded_error_trials", "latency", "cost")


def run_summary(trials: DataFrame) -> dict[str, DataFrame]:
    """All parts of a run's summary, each a table."""
    scored = eligible(trials)
    groups = cohorts(trials)
    return {"pass_k_curve": pass_k_curve(groups), "pass_k_cohorts": groups, "error_counts": error_counts(trials), "excluded_error_trials": excluded_errors(trials), "latency": latency(scored), "cost": cost_summary(scored)}


def session_failed(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.bool_or(F.col("verdict") != "pass"), F.lit(False)).alias("failed"))


def readiness(groups: DataFrame) -> DataFrame:
    passing = F.col("verdict") == "pass"
    return groups.agg(F.count_if(passing & F.col("smoke")).cast("long").alias("smoke_passing"), F.count_if(passing & ~F.col("smoke")).cast("long").alias("domain_passing"))


def latest(trials: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key: the last row wins. Aggregated on the map side, so a key's history isn't shuffled."""
    rest = [c for c in trials.columns if c != key]
    return trials.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def snapshot_merge(stored: DataFrame, fresh: DataFrame, payload: list[str]) -> DataFrame:
    """Fresh snapshots replace stored provisional rows; final rows take only the payload columns they lack."""
    f = fresh.select("nodeid", *[F.col(c).alias(f"fresh_{c}") for c in fresh.columns if c != "nodeid"], F.lit(True).alias("has_fresh"))
    j = stored.withColumn("has_stored", F.lit(True)).join(f, "nodeid", "full_outer")
    final = F.coalesce(F.col("has_stored") & (F.col("status") != "provisional"), F.lit(False))
    columns = [F.when(final, F.coalesce(F.col(f"fresh_{c}"), F.col(c)) if c in payload else F.col(c)).otherwise(F.coalesce(F.col(f"fresh_{c}"), F.col(c))).alias(c) for c in stored.columns if c != "nodeid"]
    return j.select("nodeid", *columns)


def expand_trials(cases: DataFrame, key: str, trials: Column) -> DataFrame:
    """Each case once for every trial from 1 to its number."""
    return cases.select(key, F.explode(F.sequence(F.lit(1).cast("long"), trials.cast("long"))).alias("trial_index"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Verdicts of two runs side by side: recurring, regressed, improved, run-specific or steady."""
    a, b = before.select("group_id", F.col("verdict").alias("before")), after.select("group_id", F.col("verdict").alias("after"))
    j = a.join(b, "group_id", "full_outer")
    bad_before, bad_after = F.col("before") != "pass", F.col("after") != "pass"
    change = F.when(F.col("before").isNull() | F.col("after").isNull(), "run-specific").when(bad_before & bad_after, "recurring").when(bad_after, "regressed").when(bad_before, "improved").otherwise("steady")
    return j.withColumn("change", change)
