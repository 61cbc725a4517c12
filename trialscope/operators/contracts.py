"""Contract checks: each returns its violations as rows (rule, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions import formats
from trialscope.operators import scoring

ROLES = ("system", "developer", "user", "assistant", "tool")


def _rows(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    g = df.groupBy(*keys).count().filter("count > 1")
    return _rows(g, rule, F.concat_ws("/", *keys), F.col("count"))


def configured_constant(trials: DataFrame) -> DataFrame:
    g = trials.groupBy("group_id").agg(F.min("configured_trials").alias("low"), F.max("configured_trials").alias("high")).filter("low <> high")
    return _rows(g, "configured_trials differ", F.col("group_id"), F.concat_ws("..", "low", "high"))


def ordered(trials: DataFrame, ordinal: str) -> DataFrame:
    """Rows stored out of the order (group, index, node). A neighbour in the wanted order with a lower ordinal."""
    w = Window.partitionBy("group_id").orderBy("trial_index", "nodeid")
    bad = trials.withColumn("before", F.lag(ordinal).over(w)).filter(F.col("before") > F.col(ordinal))
    return _rows(bad, "out of order", F.col("nodeid"), F.col(ordinal))


def trial_rows(trials: DataFrame) -> DataFrame:
    """Index within the configured number; a failure exactly on fail, error and skipped; known statuses; a case's own id,
    where the column inner_case_id has it, is the trial's."""
    has = F.col("failure_kind").isNotNull()
    rules = {
        "trial_index out of range": (F.col("trial_index") < 1) | (F.col("trial_index") > F.col("configured_trials")),
        "failure missing": F.col("status").isin("fail", "error", "skipped") & ~has,
        "failure not wanted": F.col("status").isin("pass", "provisional") & has,
        "unknown status": ~F.col("status").isin(*formats.STATUSES),
        "unknown category": F.col("failure_category").isNotNull() & ~F.col("failure_category").isin(*formats.CATEGORIES),
    }
    if "inner_case_id" in trials.columns:
        rules["case id differs"] = F.col("inner_case_id") != F.col("case_id")
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return trials.select(F.explode(found).alias("rule"), F.col("nodeid").cast("string").alias("key"), F.col("status").alias("detail"))


def derived_equal(trials: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored aggregates that differ from those derived anew, on either side, as often as one side has them more: both
    sides are counted in one pass."""
    now = scoring.verdicts(trials)
    columns = [c for c in now.columns if c in stored.columns]
    both = now.select(*columns, F.lit(1).alias("n")).unionByName(stored.select(*columns, F.lit(-1).alias("n")))
    odd = both.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    rule = F.when(F.col("n") > 0, "aggregate missing").otherwise("aggregate not derived")
    return odd.select(rule.alias("rule"), F.col("group_id").cast("string").alias("key"), F.col("verdict").cast("string").alias("detail"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n")))).drop("col")


def nested_trials(aggregates: DataFrame, trials: DataFrame) -> DataFrame:
    """aggregates: group_id, case_id, nodeids. Embedded trials that aren't the aggregate's own, and trials that ran but
    are embedded in none."""
    inner = aggregates.select("group_id", "case_id", F.explode("nodeids").alias("nodeid"))
    ran = trials.filter("status <> 'skipped'").select("group_id", "case_id", "nodeid")
    keys = ["group_id", "case_id", "nodeid"]
    unknown = _rows(inner.join(trials.select(*keys), keys, "left_anti"), "embedded trial unknown", F.col("nodeid"), F.col("group_id"))
    return unknown.unionByName(_rows(ran.join(inner, keys, "left_anti"), "trial not embedded", F.col("nodeid"), F.col("group_id")))


def summary_equal(trials: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Parts of a stored summary that differ from those derived anew, on either side; stored as from run_summary.
    Fractions are compared to six digits: sums of them hang on the order of summands."""
    now = scoring.run_summary(trials)

    def as_row(df: DataFrame) -> DataFrame:
        columns = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)]
        return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))

    parts = []
    for name, df in now.items():
        a, b = as_row(df), as_row(stored[name].select(df.columns))
        parts += [_rows(a.exceptAll(b), f"{name} missing", F.lit(name), F.col("row")), _rows(b.exceptAll(a), f"{name} not derived", F.lit(name), F.col("row"))]
    return all_of(*parts)


def run_complete(run: DataFrame) -> DataFrame:
    bad = run.filter(F.col("complete") & (F.col("interruption").isNotNull() | (F.col("provisional") > 0)))
    return _rows(bad, "complete run is interrupted or provisional", F.col("run_id"), F.col("provisional"))


def messages(rows: DataFrame) -> DataFrame:
    """Chat message rules over (case_id, turn, role, content, tool_calls array<struct<id>>, tool_call_id): known roles,
    text where it is due; each call of an assistant turn is answered once, by id, before the next other turn or the end,
    and nothing else is answered.

    A turn that isn't a tool's opens a block, which its answers belong to; ids may come again in a later block. One
    shuffle, by case.
    """
    w = Window.partitionBy("case_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast("array<string>")
    ids = F.when(F.col("tool_calls").isNotNull(), F.transform("tool_calls", lambda c: c["id"]))
    m = rows.withColumns({"ids": ids, "block": F.count_if(F.col("role") != "tool").over(w)})
    calls = F.coalesce(F.size(F.coalesce("ids", none)), F.lit(0))
    speaks = F.col("role") == "assistant"
    rules = {
        "unknown role": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)),
        "no text": F.col("role").isin("system", "developer", "user", "tool") & F.col("content").isNull(),
        "empty assistant turn": speaks & F.col("content").isNull() & F.col("ids").isNull(),
        "empty tool calls": speaks & F.col("ids").isNotNull() & (calls == 0),
        "tool call without id": F.exists(F.coalesce("ids", none), lambda x: F.coalesce(x, F.lit("")) == ""),
        "repeated tool call id": calls > F.size(F.array_distinct(F.coalesce("ids", none))),
        "tool calls outside an assistant turn": ~speaks & (calls > 0),
        "answer without id": (F.col("role") == "tool") & (F.coalesce("tool_call_id", F.lit("")) == ""),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    one = lambda rule, made, call: F.struct(rule.cast("string").alias("rule"), made.cast("boolean").alias("made"), call.cast("string").alias("call"))
    null = F.lit(None)
    broken = F.transform(found, lambda rule: one(rule, null, null))
    made = F.transform(F.filter(F.array_distinct(F.when(speaks, F.coalesce("ids", none)).otherwise(none)), lambda x: x != ""), lambda x: one(null, F.lit(True), x))
    answer = F.filter(F.array(one(null, F.lit(False), F.when(F.col("role") == "tool", F.col("tool_call_id")))), lambda x: x["call"] != "")
    e = m.select("case_id", "block", "turn", "role", F.inline(F.concat(broken, made, answer)))
    # a call and its answers lie together, the answers first and of these the last one first
    call = Window.partitionBy("case_id", "block", "call").orderBy("made", F.desc("turn"))
    whole = call.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumns({"at": F.row_number().over(call), "calls": F.count_if("made").over(whole), "answers": F.count_if(~F.col("made")).over(whole)})
    by_call = F.when(F.col("made"), F.when(F.col("answers") == 0, "tool call not answered")).when(F.col("calls") == 0, "unknown tool call id").when((F.col("answers") > 1) & (F.col("at") == 1), "tool call answered again")
    e = e.withColumns({"detail": F.when(F.col("rule").isNotNull(), F.col("role")).otherwise(F.col("call")), "rule": F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("made").isNotNull(), by_call)})
    return e.filter("rule is not null").select("rule", F.concat_ws("/", F.col("case_id").cast("string"), F.col("turn").cast("string")).alias("key"), "detail")


def case_rows(cases: DataFrame) -> DataFrame:
    """Cases (id, has_input, has_messages): an id, and not both an input and messages."""
    rules = {"no id": F.coalesce(F.col("id"), F.lit("")) == "", "both input and messages": F.col("has_input") & F.col("has_messages")}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return cases.select(F.explode(found).alias("rule"), F.col("id").cast("string").alias("key"), F.lit("case").alias("detail"))


def alternation(rows: DataFrame) -> DataFrame:
    """Turns whose role is that of the turn before, system turns left out."""
    w = Window.partitionBy("case_id").orderBy("turn")
    bad = rows.filter("role in ('user', 'assistant')").withColumn("before", F.lag("role").over(w)).filter("before = role")
    return _rows(bad, "role repeats", F.concat_ws("/", F.col("case_id").cast("string"), F.col("turn").cast("string")), F.col("role"))


def visible_history(rows: DataFrame) -> DataFrame:
    """User and assistant turns with text; roles inverted for the simulator are in `inverted`."""
    keep = rows.filter(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return keep.select("case_id", "turn", "role", "content", F.when(F.col("role") == "user", "assistant").otherwise("user").alias("inverted"))


def ideas(rows: DataFrame) -> DataFrame:
    """Ideas: an id in form, trace ids that aren't blank, a known status, and the other required texts that rows has."""
    rules = {
        "bad id": ~F.col("id").rlike("^[a-z0-9][a-z0-9-]{0,63}$"),
        "no trace ids": F.coalesce(F.size("trace_ids"), F.lit(0)) < 1,
        "blank trace id": F.exists("trace_ids", lambda x: F.trim(x) == ""),
        "unknown status": ~F.col("status").isin(*formats.IDEA_STATUSES),
    }
    rules |= {f"no {c}": F.trim(c) == "" for c in ("source", "failure_pattern", "expected_outcome") if c in rows.columns}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("rule"), F.col("id").alias("key"), F.col("status").alias("detail"))


def fingerprints_equal(rows: DataFrame, fingerprint: Column, stored: str = "semantic_fingerprint") -> DataFrame:
    """Rows whose stored fingerprint isn't the one derived from their texts."""
    return _rows(rows.filter(~F.col(stored).eqNullSafe(fingerprint)), "fingerprint differs", F.col("id"), F.col(stored))


def agent_runs(events: DataFrame) -> DataFrame:
    """Events of a run: unique ids, strictly increasing sequence, no event its own parent, no end before its start."""
    w = Window.partitionBy("run_id").orderBy("ord")
    e = events.withColumn("before", F.lag("sequence").over(w))
    rules = {"sequence does not increase": F.col("sequence") <= F.col("before"), "own parent": F.col("parent_id") == F.col("id"), "ends before start": F.col("ended_at") < F.col("started_at")}
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    by_row = e.select(F.explode(found).alias("rule"), F.concat_ws("/", "run_id", "id").alias("key"), F.col("sequence").cast("string").alias("detail"))
    return by_row.unionByName(repeated(events, "repeated event id", "run_id", "id"))


def run_completeness(runs: DataFrame) -> DataFrame:
    """Runs (run_id, trajectory_completeness, state_completeness, incomplete_reason): a reason exactly if incomplete."""
    complete = (F.col("trajectory_completeness") == "complete") & (F.col("state_completeness") == "complete")
    has = F.col("incomplete_reason").isNotNull()
    rule = F.when(complete & has, "reason not wanted").when(~complete & ~has, "reason missing").when(has & (F.trim("incomplete_reason") == ""), "blank reason")
    return runs.withColumn("rule", rule).filter("rule is not null").select("rule", F.col("run_id").cast("string").alias("key"), F.col("incomplete_reason").alias("detail"))


def judge_results(rows: DataFrame) -> DataFrame:
    """Outcome of each judge result: a broken contract, an execution error, a failed assertion, or ok."""
    broken = F.col("passed").isNull() | F.coalesce(F.trim("reasoning") == "", F.lit(True))
    kind = F.when(broken, "contract").when(F.coalesce("error", F.lit(False)), "execution").when(~F.col("passed"), "assertion").otherwise("ok")
    status = F.when(kind == "ok", "pass").when(kind == "assertion", "fail").otherwise("error")
    return rows.withColumns({"status": status, "category": F.when(kind == "ok", None).when(kind == "assertion", "agent").otherwise("judge"), "kind": kind})


def judge_snapshots(rows: DataFrame) -> DataFrame:
    """Judge results with broken ones replaced: not passed, in error, and of their fields only who judged."""
    broken = F.col("passed").isNull() | F.coalesce(F.trim("reasoning") == "", F.lit(True))
    return rows.withColumns({
        "passed": F.when(broken, F.lit(False)).otherwise(F.col("passed")),
        "reasoning": F.when(broken, F.lit("the judge's result breaks its contract")).otherwise(F.trim("reasoning")),
        "error": F.when(broken, F.lit(True)).otherwise(F.coalesce("error", F.lit(False))),
    })


def markers(rows: DataFrame) -> DataFrame:
    """Markers (nodeid, trials, timeout_s): at least one trial, a positive finite timeout if any."""
    timeout = F.col("timeout_s")
    rules = {"trials below 1": F.coalesce(F.col("trials") < 1, F.lit(False)), "timeout not positive and finite": timeout.isNotNull() & (F.isnan(timeout) | (timeout <= 0) | (timeout == F.lit(float("inf"))))}
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("rule"), F.col("nodeid").alias("key"), timeout.cast("string").alias("detail"))


def assertions(rows: DataFrame, checks: dict[str, Column], key: str = "trace_id") -> DataFrame:
    """Each named condition over traces or calls, as (key, check, passed); null counts as not passed."""
    named = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))
    return rows.select(key, F.explode(named).alias("c")).select(key, "c.check", "c.passed")


def publishable(trials: DataFrame) -> DataFrame:
    """Running trials whose snapshot may be shown: an output was recorded, or only a trace was asked for."""
    return trials.filter(F.col("output_recorded") | F.col("trace_only"))


def env_judge(setting: Column) -> Column:
    """pass, fail or error from a judge setting."""
    t = F.lower(F.trim(setting))
    return F.when(t.isin("1", "true", "pass", "passed", "yes"), "pass").when(t == "error", "error").otherwise("fail")


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def trial_contract(trials: DataFrame) -> DataFrame:
    """All rules over trials. Those on groups come from one aggregate: repeated indexes are pairs of a group that occur
    more often than once, a changing number of trials is seen by its bounds."""
    pairs = trials.groupBy("group_id", "trial_index").agg(F.count("*").alias("n"), F.min("configured_trials").alias("low"), F.max("configured_trials").alias("high"))
    by_pair = _rows(pairs.filter("n > 1"), "repeated trial", F.concat_ws("/", "group_id", "trial_index"), F.col("n"))
    groups = pairs.groupBy("group_id").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    by_group = _rows(groups, "configured_trials differ", F.col("group_id"), F.concat_ws("..", "low", "high"))
    return all_of(repeated(trials, "repeated node id", "nodeid"), by_pair, by_group, trial_rows(trials))
