"""All registered queries of the trace and trial side, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialscope.functions import expr
from trialscope.operators import contracts, detectors, queues, redaction, scoring, traces
from trialscope.plans.adapters import spans, table, trials
from trialscope.plans.register import ORACLES, QUERIES, query
from trialscope.sources.stage import staged

KEY = b"0123456789abcdef0123456789abcdef"


VERDICTS_SQL = """WITH g AS (SELECT group_id, arg_min(case_id, trial_index) FILTER (status <> 'skipped') AS case_id, max(configured_trials) AS configured_trials,
    count(*) FILTER (status <> 'skipped') AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed,
    count(*) FILTER (status = 'error') AS errored, count(*) FILTER (status = 'skipped') AS skipped,
    bool_or(coalesce(status <> 'skipped' AND failure_kind = 'timeout', false)) AS timed_out, bool_or(smoke) AS smoke FROM trials GROUP BY group_id),
    v AS (SELECT * EXCLUDE (timed_out), total + skipped < configured_trials AS partial, CASE WHEN timed_out THEN 'error' WHEN total + skipped < configured_trials THEN 'partial'
    WHEN errored > 0 THEN 'error' WHEN passed = total THEN 'pass' WHEN failed = total THEN 'fail' ELSE 'flaky' END AS verdict FROM g WHERE total > 0)
"""
ELIGIBLE_SQL = "WITH e AS (SELECT * FROM trials WHERE NOT smoke AND (status IN ('pass', 'fail') OR status = 'error' AND failure_category = 'agent'))"
COHORTS_SQL = ELIGIBLE_SQL + ", c AS (SELECT group_id, arg_min(case_id, trial_index) AS case_id, count(*) FILTER (status = 'pass') AS passed, count(*) AS total FROM e GROUP BY group_id)"


@query(VERDICTS_SQL + "SELECT * FROM v", "trials")
def trial_verdicts(spark, d):
    return scoring.verdicts(trials(spark, d))


@query(VERDICTS_SQL + "SELECT verdict, count(*) AS groups FROM v GROUP BY verdict", "trials")
def verdict_histogram(spark, d):
    return scoring.verdicts(trials(spark, d)).groupBy("verdict").agg(F.count("*").alias("groups"))


@query(VERDICTS_SQL + "SELECT group_id, configured_trials, total, skipped FROM v WHERE partial", "trials")
def partial_groups(spark, d):
    return scoring.verdicts(trials(spark, d)).filter("partial").select("group_id", "configured_trials", "total", "skipped")


@query(ELIGIBLE_SQL + " SELECT group_id, trial_index, status, duration_ms FROM e", "trials")
def eligible_trials(spark, d):
    return scoring.eligible(trials(spark, d)).select("group_id", "trial_index", "status", "duration_ms")


@query(COHORTS_SQL + " SELECT * FROM c", "trials")
def reliability_cohorts(spark, d):
    return scoring.cohorts(trials(spark, d))


@query(COHORTS_SQL + """, p AS (SELECT k, CASE WHEN passed < k THEN 0.0::DOUBLE ELSE list_product([(passed - i)::DOUBLE / (total - i) for i in range(k)]) END AS v
    FROM c, unnest(range(1, total + 1)) t(k)) SELECT k, round(avg(v), 9) AS value, count(*) AS cohorts FROM p GROUP BY k""", "trials")
def pass_k_curve(spark, d):
    return scoring.pass_k_curve(scoring.cohorts(trials(spark, d))).withColumn("value", F.round("value", 9))


@query(ELIGIBLE_SQL + """, s AS (SELECT list_sort(list(duration_ms)) AS xs, median(duration_ms) AS p50, avg(duration_ms) AS mean FROM e)
    SELECT round(p50, 6) AS latency_p50_ms, xs[round_even(0.95::DOUBLE * (len(xs) - 1), 0)::INT + 1] AS latency_p95_ms, round(mean, 6) AS latency_mean_ms FROM s""", "trials")
def latency_summary(spark, d):
    s = scoring.latency(scoring.eligible(trials(spark, d)))
    return s.select(F.round("latency_p50_ms", 6).alias("latency_p50_ms"), "latency_p95_ms", F.round("latency_mean_ms", 6).alias("latency_mean_ms"))


@query(ELIGIBLE_SQL + """ SELECT group_id, trial_index, true AS relevant, coalesce(cost_usd <> 0, false) AS complete, round(CASE WHEN cost_usd <> 0 THEN cost_usd END, 9) AS observed_cost FROM e""", "trials")
def cost_observations(spark, d):
    o = scoring.cost_observation(scoring.eligible(trials(spark, d)))
    return o.select("group_id", "trial_index", "relevant", "complete", F.round("observed_cost", 9).alias("observed_cost"))


@query(ELIGIBLE_SQL + """, o AS (SELECT status, llm_turns, CASE WHEN cost_usd <> 0 THEN cost_usd END AS cost FROM e), s AS (SELECT sum(cost) AS known, count(cost) AS priced, count(*) AS relevant, avg(llm_turns) AS turns,
    count(*) FILTER (status = 'pass') AS passes FROM o)
    SELECT CASE WHEN priced = relevant THEN round(known, 6) END AS total_cost_usd, round(known, 6) AS known_cost_usd, CASE WHEN priced = relevant THEN round(known / passes, 9) END AS cost_per_pass_usd,
    round(turns, 6) AS mean_llm_turns, priced AS cost_known_trials, relevant AS cost_relevant_trials, round(priced / relevant, 9) AS cost_coverage, priced > 0 AS has_cost, priced = relevant AS cost_complete,
    priced > 0 AND priced < relevant AS cost_partial FROM s""", "trials")
def cost_summary(spark, d):
    s = scoring.cost_summary(scoring.eligible(trials(spark, d)))
    digits = {"total_cost_usd": 6, "known_cost_usd": 6, "cost_per_pass_usd": 9, "mean_llm_turns": 6, "cost_coverage": 9}
    return s.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in s.columns))


@query("""SELECT c.category, count(t.status) AS errors FROM (VALUES ('agent'), ('simulator'), ('judge'), ('configuration'), ('infrastructure'), ('harness'), ('unknown')) c(category)
    LEFT JOIN trials t ON t.failure_category = c.category AND t.status = 'error' AND NOT t.smoke GROUP BY c.category""", "trials")
def error_counts(spark, d):
    return scoring.error_counts(trials(spark, d))


@query("SELECT count(*) AS excluded_error_trials FROM trials WHERE status = 'error' AND NOT smoke AND failure_category <> 'agent'", "trials")
def excluded_errors(spark, d):
    return scoring.excluded_errors(trials(spark, d))


@query("SELECT group_id, arg_max(trial_index, trial_index) AS trial_index, arg_max(status, trial_index) AS status FROM trials GROUP BY group_id", "trials")
def trial_upsert_latest(spark, d):
    return scoring.latest(trials(spark, d).select("group_id", "trial_index", "status").withColumn("ord", F.col("trial_index")), "group_id", "ord").drop("ord")


@query("SELECT o_orderkey, unnest(range(1, 2 + (o_orderkey % 3))) AS trial_index FROM orders")
def trial_expansion(spark, d):
    return scoring.expand_trials(table(spark, d, "orders"), "o_orderkey", F.col("o_orderkey") % 3 + 1)


@query(VERDICTS_SQL + "SELECT bool_or(verdict <> 'pass') AS failed FROM v", "trials")
def session_gate(spark, d):
    return scoring.session_failed(scoring.verdicts(trials(spark, d)))


@query(VERDICTS_SQL + "SELECT count(*) FILTER (verdict = 'pass' AND smoke) AS smoke_passing, count(*) FILTER (verdict = 'pass' AND NOT smoke) AS domain_passing FROM v", "trials")
def eval_readiness(spark, d):
    return scoring.readiness(scoring.verdicts(trials(spark, d)))


@query("""WITH a AS (SELECT group_id, bool_and(status = 'pass') AS ok FROM trials WHERE trial_index <= 2 GROUP BY group_id), b AS (SELECT group_id, bool_and(status = 'pass') AS ok FROM trials WHERE trial_index > 2 GROUP BY group_id)
    SELECT group_id, CASE WHEN a.ok IS NULL THEN NULL WHEN a.ok THEN 'pass' ELSE 'fail' END AS before, CASE WHEN b.ok IS NULL THEN NULL WHEN b.ok THEN 'pass' ELSE 'fail' END AS after,
    CASE WHEN a.ok IS NULL OR b.ok IS NULL THEN 'run-specific' WHEN NOT a.ok AND NOT b.ok THEN 'recurring' WHEN NOT b.ok THEN 'regressed' WHEN NOT a.ok THEN 'improved' ELSE 'steady' END AS change
    FROM a FULL JOIN b USING (group_id)""", "trials")
def run_diff(spark, d):
    verdict = lambda t: t.groupBy("group_id").agg(F.when(F.bool_and(F.col("status") == "pass"), "pass").otherwise("fail").alias("verdict"))
    t = trials(spark, d).select("group_id", "trial_index", "status")
    return scoring.run_diff(verdict(t.filter("trial_index <= 2")), verdict(t.filter("trial_index > 2")))


@query("""WITH t AS (SELECT *, group_id || '::' || trial_index AS nodeid FROM trials) SELECT 'repeated node' AS rule, l_orderkey || '/' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'failure missing', nodeid, status FROM t WHERE status IN ('fail', 'error', 'skipped') AND failure_kind IS NULL""", "trials")
def contract_violations(spark, d):
    li = contracts.repeated(table(spark, d, "lineitem"), "repeated node", "l_orderkey", "l_linenumber")
    return contracts.all_of(li, contracts.trial_contract(staged(trials(spark, d), "trials")))  # read by several checks


@query("SELECT span_id, status, kind, tool_name FROM spans", "spans")
def span_fields(spark, d):
    return spans(spark, d).select("span_id", "status", "kind", "tool_name")


STATUS_SQL = """CASE WHEN t IS NULL OR t = '' THEN 'unknown' WHEN contains(t, 'error') OR contains(t, 'fail') OR t IN ('2', 'false', 'ko') THEN 'error'
    WHEN t IN ('0', '1', '200', 'default', 'ok', 'pass', 'passed', 'success', 'succeeded', 'status_code_ok', 'status_code_unset', 'true', 'unset') THEN 'ok' ELSE 'unknown' END"""


@query(f"SELECT event_id, {STATUS_SQL} AS status FROM (SELECT event_id, lower(trim([event_type, ' OK ', 'false', '200', 'no failures', '', 'odd'][(event_id % 7)::INT + 1])) AS t FROM events)")
def span_status(spark, d):
    words = F.array(F.col("event_type"), *map(F.lit, (" OK ", "false", "200", "no failures", "", "odd")))
    return table(spark, d, "events").select("event_id", expr.status_of(F.element_at(words, (F.col("event_id") % 7).cast("int") + 1)).alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (json_extract_string(props, '$.k'))::BIGINT + 7 WHEN event_id % 4 = 1 THEN 5 WHEN event_id % 4 = 2 THEN NULL ELSE event_id % 100 END AS total_tokens FROM events")
def token_totals(spark, d):
    n = F.col("event_id") % 4
    given, inputs, outputs = F.when(n == 3, F.col("event_id") % 100), F.when(n == 0, F.get_json_object("props", "$.k").try_cast("long")), F.when(n == 0, F.lit(7).cast("long")).when(n == 1, F.lit(5).cast("long"))
    return table(spark, d, "events").select("event_id", expr.total_tokens(given, inputs, outputs).cast("long").alias("total_tokens"))


@query("SELECT span_id, started_at, ended_at, round(greatest(0.0, (ended_at - started_at) / 1e6::DOUBLE), 6) AS duration_ms FROM spans", "spans")
def span_nanos(spark, d):
    return spans(spark, d).select("span_id", "started_at", "ended_at", F.round(expr.duration_ms(F.col("started_at"), F.col("ended_at")), 6).alias("duration_ms"))


ROLLUP_SQL = """WITH r AS (SELECT trace_id, arg_min(name, (started_at, span_id)) AS name, min(started_at) AS started_at, max(ended_at) AS ended_at, round((max(ended_at) - min(started_at)) / 1e6::DOUBLE, 6) AS duration_ms,
    CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'unknown' END AS status, count(*) AS span_count, min((started_at, span_id)) AS first FROM spans GROUP BY trace_id)
"""


@query(ROLLUP_SQL + "SELECT * EXCLUDE (first) FROM r", "spans")
def trace_rollup(spark, d):
    return traces.rollup(spans(spark, d)).withColumn("duration_ms", F.round("duration_ms", 6))


@query(ROLLUP_SQL + "SELECT s.trace_id, s.span_id FROM spans s JOIN (SELECT trace_id FROM r ORDER BY first LIMIT 25) USING (trace_id)", "spans")
def trace_first_n(spark, d):
    return traces.first_traces(spans(spark, d), 25).select("trace_id", "span_id")


@query(ROLLUP_SQL + "SELECT * EXCLUDE (first) FROM r WHERE trace_id = '7'", "spans")
def trace_point_lookup(spark, d):
    e = spans(spark, d).filter(F.col("trace_id") == "7")
    return traces.rollup(e).withColumn("duration_ms", F.round("duration_ms", 6))


@query(ROLLUP_SQL + "SELECT trace_id, span_count FROM r ORDER BY first LIMIT 1", "spans")
def trace_sample(spark, d):
    return traces.rollup(traces.first_traces(spans(spark, d), 1)).select("trace_id", "span_count")


@query("SELECT trace_id, span_id, tool_name AS tool, status, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) - 1 AS sequence FROM spans WHERE tool_name IS NOT NULL", "spans")
def tool_calls(spark, d):
    return traces.tool_calls(spans(spark, d)).select("trace_id", "span_id", "tool", "status", "sequence")


NAMES_SQL = "WITH n AS (SELECT trace_id, list(tool_name ORDER BY started_at, span_id) AS names FROM spans WHERE tool_name IS NOT NULL GROUP BY trace_id)"


def _names(spark, d):
    return traces.tool_names(traces.tool_calls(spans(spark, d)))


@query(NAMES_SQL + " SELECT trace_id, array_to_string(names, ',') AS names FROM n", "spans")
def tool_names(spark, d):
    return _names(spark, d).select("trace_id", F.array_join("names", ",").alias("names"))


@query(NAMES_SQL + " SELECT trace_id, list_has_all(names, ['click', 'purchase']) AS both, NOT list_has_any(names, ['purchase']) AS no_purchase, len(names) = len(list_distinct(names)) AS unique_names FROM n", "spans")
def tools_include_exclude(spark, d):
    checks = traces.tool_checks(traces.tool_calls(spans(spark, d)), ["click", "purchase"], ["purchase"])
    return checks.select("trace_id", F.col("includes").alias("both"), F.col("excludes").alias("no_purchase"), F.col("no_repeats").alias("unique_names"))


@query(NAMES_SQL + " SELECT trace_id, regexp_matches(array_to_string(names, ','), '(^|,)click(,.*)?,purchase(,.*)?,purchase(,.*)?,click') AS in_order FROM n", "spans")
def tools_order(spark, d):
    return _names(spark, d).select("trace_id", expr.subsequence(["click", "purchase", "purchase", "click"], F.col("names")).alias("in_order"))


@query("SELECT trace_id, span_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) - 1 AS sequence FROM spans WHERE tool_name IS NOT NULL) WHERE tool_name = 'click' AND json_extract(props, '$.k')::BIGINT = 3", "spans")
def tools_matching(spark, d):
    calls = traces.tool_calls(spans(spark, d)).withColumns({"arguments": F.try_parse_json("props"), "arguments_recorded": F.lit(True)})
    return traces.matching(calls, "click", arguments={"k": 3}).select("trace_id", "span_id", "sequence")


@query("SELECT event_id, json_type(props, '$.k') = 'UBIGINT' AND json_extract(props, '$.k')::BIGINT = 3 AS matched FROM events")
def args_containment(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(traces.contains_json(v, {"k": 3}), F.lit(False)).alias("matched"))


@query("""WITH s AS (SELECT trace_id || '-' || (span_id % 3) AS trace_id, kind, CASE WHEN span_id % 5 > 0 OR kind <> 'llm' THEN cost_usd END AS cost_usd FROM spans),
    c AS (SELECT trace_id, round(sum(cost_usd), 6) AS known_cost, count(*) FILTER (kind = 'llm' OR cost_usd IS NOT NULL) > 0 AND bool_and(cost_usd IS NOT NULL OR kind <> 'llm') AS cost_available FROM s GROUP BY trace_id)
    SELECT *, CASE WHEN cost_available THEN known_cost END AS cost FROM c""", "spans")
def trace_cost(spark, d):
    s = spans(spark, d).withColumns({"trace_id": F.concat_ws("-", "trace_id", (F.col("span_id") % 3).cast("string")), "cost_usd": F.when((F.col("span_id") % 5 > 0) | (F.col("kind") != "llm"), F.col("cost_usd"))})
    return traces.costs(s).select("trace_id", F.round("known_cost", 6).alias("known_cost"), "cost_available", F.round("cost", 6).alias("cost"))


@query("SELECT trace_id, count(*) FILTER (kind = 'llm') AS llm_turns, round((max(ended_at) - min(started_at)) / 1e6::DOUBLE, 6) AS extent_ms FROM spans GROUP BY trace_id", "spans")
def trace_measures(spark, d):
    return traces.measures(spans(spark, d)).withColumn("extent_ms", F.round("extent_ms", 6))


@query("""WITH u AS (SELECT trace_id, span_id, started_at, 0 AS source, 0 AS run, span_id AS sequence FROM spans UNION ALL SELECT o_custkey::VARCHAR, o_orderkey, NULL, 1, o_orderkey % 5, o_orderkey FROM orders)
    SELECT trace_id, span_id, source, row_number() OVER (PARTITION BY trace_id ORDER BY started_at IS NULL, coalesce(started_at, 0), source, run, sequence) - 1 AS position FROM u""", "spans")
def merged_spans(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("trace_id"), F.col("o_orderkey").alias("span_id"), F.lit("order").alias("name"), F.lit(None).cast("long").alias("started_at"), (F.col("o_orderkey") % 5).alias("run"), F.col("o_orderkey").alias("sequence"))
    return traces.merge_spans(spans(spark, d).withColumn("sequence", F.col("span_id")), o).select("trace_id", "span_id", "source", "position")


@query("""SELECT e.event_id AS span_id, CASE WHEN p.event_id IS NOT NULL THEN e.event_id - 1 - e.event_id % 150 END AS parent_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_id = e.event_id - 1 - e.event_id % 150""")
def parent_resolution(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - 1 - F.col("event_id") % 150).alias("parent_id"))
    return traces.resolve_parents(e).select("span_id", "parent_id")


@query("SELECT o_orderkey AS trace_id, l_linenumber AS observation, l_quantity AS amount FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def observations_left_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("trace_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("observation"), F.col("l_quantity").alias("amount"))
    return traces.attach_observations(o, li)


def _hmac_sql(message: str) -> str:
    pads = ["".join(f"{b ^ pad:02x}" for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
    inner = f"sha256(from_hex('{pads[0]}') || encode({message}))"
    return f"sha256(from_hex('{pads[1]}') || from_hex({inner}))"


@query(f"SELECT c_custkey, 'trace_' || {_hmac_sql(chr(39) + 'trace' + chr(39) + ' || chr(0) || c_custkey::VARCHAR || chr(0) || c_name')}[1:24] AS pseudonym FROM customer")
def pseudonym_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", expr.pseudonym(KEY, "trace", F.col("c_custkey"), F.col("c_name")).alias("pseudonym"))


@query(r"""SELECT doc_id, 'sha256:' || sha256('["' || trim(regexp_replace(lower(text), '[\s]+', ' ', 'g')) || '"]') AS fingerprint FROM documents WHERE regexp_full_match(text, '[a-zA-Z .,\n]+')""")
def fingerprints(spark, d):
    plain = table(spark, d, "documents").filter(F.col("text").rlike(r"^[a-zA-Z .,\n]+$"))
    return plain.select("doc_id", queues.fingerprint(F.col("text"), fold=F.lower).alias("fingerprint"))


@query()
def document_fingerprints(spark, d):
    """Of every document; fingerprints is the part that SQL can fold."""
    return table(spark, d, "documents").select("doc_id", queues.fingerprint(F.col("text")).alias("fingerprint"))


def _ideas(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("failure_pattern"), F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("file"))
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.concat(F.lit("idea-"), (F.col("doc_id") % 50).cast("string")).alias("id"), F.array("doc_id", F.col("doc_id") + 1).alias("trace_ids"), status.alias("status"), "failure_pattern", "file", "doc_id")


IDEAS_SQL = """WITH i AS (SELECT 'idea-' || (doc_id % 50) AS id, doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS status, source || '/' || (doc_id % 7) AS file
    FROM labels JOIN documents USING (doc_id))"""


@query(IDEAS_SQL + " SELECT id, count(*) AS n FROM i GROUP BY id HAVING count(*) > 1")
def idea_duplicates(spark, d):
    return queues.duplicate_ids(_ideas(spark, d))


@query(IDEAS_SQL + " SELECT id, count(DISTINCT file) AS n_files, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM i GROUP BY id HAVING count(DISTINCT file) > 1")
def idea_cross_file(spark, d):
    return queues.cross_file_duplicates(_ideas(spark, d)).withColumn("files", F.array_join("files", ","))


@query(IDEAS_SQL + " SELECT DISTINCT t AS trace_id FROM (SELECT unnest([doc_id, doc_id + 1]) AS t FROM i) WHERE t NOT IN (SELECT doc_id FROM labels)")
def idea_unknown_traces(spark, d):
    return queues.unknown_traces(_ideas(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("trace_id")))


@query(IDEAS_SQL + " SELECT doc_id, id FROM i WHERE status = 'approved'")
def ideas_by_status(spark, d):
    return _ideas(spark, d).filter("status = 'approved'").select("doc_id", "id")


def _messages(spark, d):
    none = F.lit(None)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("case_id"), "turn", "role", F.col("text").alias("content"), none.cast("array<struct<id: string>>").alias("tool_calls"), none.cast("string").alias("tool_call_id"))


@query("SELECT conv_id AS case_id, turn, role, text AS content, CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS inverted FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
def visible_history(spark, d):
    return contracts.visible_history(_messages(spark, d))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'user' ELSE role END AS role FROM conversations), u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m WHERE role IN ('user', 'assistant'))
    SELECT 'role repeats' AS rule, conv_id || '/' || turn AS key, role AS detail FROM u WHERE before = role""")
def alternation_violations(spark, d):
    """Over a record in which every fifth turn is said to be a user's."""
    said = F.when((F.col("case_id") + F.col("turn")) % 5 == 0, "user").otherwise(F.col("role"))
    return contracts.alternation(_messages(spark, d).withColumn("role", said))


@query("""WITH b AS (SELECT user_id::VARCHAR AS nodeid, epoch_us(ts) / 1e6::DOUBLE AS beat, min(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY user_id) AS started FROM events)
    SELECT nodeid, floor((beat - started) / 10)::BIGINT AS slot, min(beat) AS first_beat FROM b WHERE floor((beat - started) / 10) >= 1 GROUP BY nodeid, started, slot""")
def heartbeats(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    beats = table(spark, d, "events").select(F.col("user_id").cast("string").alias("nodeid"), at.alias("at"))
    beats = beats.withColumn("started", F.min("at").over(Window.partitionBy("nodeid")))
    return queues.heartbeats(beats).select("nodeid", "slot", F.col("at").alias("first_beat"))


@query("SELECT o_orderkey FROM orders WHERE epoch_us(TIMESTAMP '1998-01-01') / 1e6::DOUBLE - epoch_us(o_orderdate) / 1e6::DOUBLE >= 86400 * 365")
def expired_trials(spark, d):
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    t = table(spark, d, "orders").select("o_orderkey", seconds(F.col("o_orderdate")).alias("started"), F.lit(86400.0 * 365).alias("timeout_s"))
    return queues.expired(t, seconds(F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 5000) / 4500.0))::BIGINT)) AS piece FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, piece, piece * 4500 AS start, sha256(substring(text, (piece * 4500 + 1)::BIGINT, 5000)) AS chunk_sha256 FROM c""")
def text_chunks(spark, d):
    c = queues.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "piece", "start", F.sha2(F.encode("chunk", "UTF-8"), 256).alias("chunk_sha256"))


@query("""WITH i AS (SELECT l_orderkey, (l_partkey % 100)::INT AS s, (l_partkey % 100)::INT + l_quantity::INT AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) AS rn FROM i),
    g AS (SELECT *, sum(CASE WHEN s < seen THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY rn) AS grp FROM m)
    SELECT l_orderkey, min(s) AS span_start, max(e) AS span_end FROM g GROUP BY l_orderkey, grp""")
def interval_union(spark, d):
    start = (F.col("l_partkey") % 100).cast("int")
    hit = F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("type"), F.lit(0.5).alias("score"), F.lit(1).alias("priority"))
    by_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(hit).alias("hits"))
    return by_order.select("l_orderkey", F.explode(redaction.union_spans(F.col("hits"))).alias("s")).select("l_orderkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}')) AS ips,
    len(regexp_extract_all(text, '[0-9]{16}')) AS cards, len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')) AS tokens FROM documents WHERE text IS NOT NULL""")
def pattern_hits(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), count(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}").alias("ips"), count("[0-9]{16}").alias("cards"), count('token = "[0-9a-f]{40}"').alias("tokens"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS endpoint FROM pages""")
def safe_endpoints(spark, d):
    return table(spark, d, "pages").select("page_id", expr.safe_endpoint(F.col("url")).alias("endpoint"))


def _emails(spark, d):
    hits = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.posexplode(hits).alias("start", "identity"))


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS identity, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), 1) AS i FROM documents),
    f AS (SELECT doc_id, identity, min(i) AS first FROM h GROUP BY doc_id, identity) SELECT doc_id, identity, row_number() OVER (ORDER BY doc_id, first) AS number FROM f""")
def alias_numbers(spark, d):
    found = _emails(spark, d).select(F.col("doc_id").alias("trace_ord"), F.lit(0).alias("leaf_ord"), "start", F.lit("EMAIL_ADDRESS").alias("type"), "identity")
    return redaction.alias_numbers(found).select(F.col("trace_ord").alias("doc_id"), "identity", F.col("number").cast("long").alias("number"))


@query()
def redacted_text(spark, d):
    leaves = table(spark, d, "documents").select(F.col("doc_id").alias("trace_ord"), F.lit(0).cast("long").alias("leaf_ord"), "text")
    return redaction.redact(leaves).select(F.col("trace_ord").alias("doc_id"), "n_spans", "redacted")


@query("""SELECT doc_id, count(*) AS n_valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS c FROM documents) WHERE c[1] IN ('2', '3', '4', '5', '6') AND
    list_sum([CASE WHEN i % 2 = 0 THEN c[16 - i]::INT ELSE (c[16 - i]::INT * 2) // 10 + (c[16 - i]::INT * 2) % 10 END for i in range(16)]) % 10 = 0 GROUP BY doc_id""")
def valid_cards(spark, d):
    cards = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).alias("c"))
    return cards.filter(expr.card_valid(F.col("c"))).groupBy("doc_id").agg(F.count("*").alias("n_valid"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b(?:[0-9][ -]?){12,18}[0-9]\b')), '[ -]', '', 'g') AS c FROM documents)
    SELECT doc_id, count(*) AS n_valid FROM c WHERE c[1] IN ('2', '3', '4', '5', '6') AND len(list_distinct(string_split(c, ''))) > 1 AND
    list_sum([CASE WHEN i % 2 = 0 THEN c[len(c) - i]::INT ELSE (c[len(c) - i]::INT * 2) // 10 + (c[len(c) - i]::INT * 2) % 10 END for i in range(len(c))]) % 10 = 0 GROUP BY doc_id""")
def document_cards(spark, d):
    """Of 13 to 19 digits, with or without separators; valid_cards sees runs of 16 digits alone."""
    found = F.regexp_extract_all("text", F.lit(f"(?U){detectors.CARD.pattern}"), F.lit(0))
    cards = table(spark, d, "documents").select("doc_id", F.explode(found).alias("c"))
    return cards.filter(expr.card_valid(F.col("c"))).groupBy("doc_id").agg(F.count("*").alias("n_valid"))


@query("""WITH e AS (SELECT user_id AS nodeid, event_id, props, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS step, 'op' || (event_id % 3) AS operation FROM events WHERE event_type IN ('view', 'click')),
    b AS (SELECT *, sum(step) OVER (PARTITION BY nodeid, operation ORDER BY event_id) AS depth, sum(step) OVER (PARTITION BY nodeid, operation) AS last FROM e)
    SELECT nodeid, arg_max(operation, event_id) AS operation FROM b WHERE step = 1 AND last > 0 AND depth = last GROUP BY nodeid""")
def open_operations(spark, d):
    e = table(spark, d, "events").filter("event_type in ('view', 'click')")
    op = F.concat(F.lit("op"), (F.col("event_id") % 3).cast("string"))
    e = e.select(F.col("user_id").alias("nodeid"), op.alias("operation"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("event"), F.col("event_id").alias("ord"))
    return queues.open_operation(e)


@query("SELECT r_name AS module, r_name AS root FROM region UNION ALL SELECT r_name || '.' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def prefix_matches(spark, d):
    region = table(spark, d, "region")
    roots = region.select(F.col("r_name").alias("root"))
    nested = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", "r_name", "n_name").alias("module"))
    return queues.prefix_matches(nested.unionByName(roots.withColumnRenamed("root", "module")), roots).select("module", "root")


from trialscope.plans import checks, readings  # noqa: E402, F401  they register theirs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
