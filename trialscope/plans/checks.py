"""Queries of the contract checks, recorded dialogues, payloads and small helpers, over rows made from the shared tables
so that every rule fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions import expr
from trialscope.operators import contracts, conversations, payloads, queues, scoring, traces
from trialscope.plans.adapters import spans, table, trials
from trialscope.plans.register import query
from trialscope.sources.stage import dealt


def text(c: str) -> Column:
    return F.col(c).cast("string")


def pick(key: Column, *values) -> Column:
    """One of the values, by the key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem),
    m AS (SELECT DISTINCT l_orderkey, l_linenumber FROM l)
    SELECT 'tool call not answered' AS rule, l_orderkey || '/1' AS key, 'c' || l_linenumber AS detail FROM m WHERE l_linenumber % 4 = 3
    UNION ALL SELECT 'unknown tool call id', l_orderkey || '/' || (1 + l_linenumber), 'x' || l_linenumber FROM m WHERE l_linenumber % 4 = 3
    UNION ALL SELECT 'tool call answered again', l_orderkey || '/' || (101 + l_linenumber), 'c' || l_linenumber FROM m WHERE l_linenumber % 4 = 2 AND l_orderkey % 5 = 0
    UNION ALL SELECT 'unknown role', l_orderkey || '/0', 'robot' FROM m WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey
    UNION ALL SELECT 'no text', l_orderkey || '/0', 'user' FROM m WHERE l_orderkey % 7 = 1 GROUP BY l_orderkey
    UNION ALL SELECT 'empty assistant turn', l_orderkey || '/300', 'assistant' FROM m WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey
    UNION ALL SELECT 'empty tool calls', l_orderkey || '/300', 'assistant' FROM m WHERE l_orderkey % 3 = 1 GROUP BY l_orderkey""")
def message_contract(spark, d):
    """A case an order: a user turn, an assistant turn with a call a line, answers, and a last turn."""
    li = dealt(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber"), "case_id")
    cases = li.groupBy("case_id").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))  # an order has a few lines
    key, none = F.col("case_id"), F.lit(None)
    call = lambda n: F.concat(F.lit("c"), n.cast("string"))
    turn = lambda turn, role, content, calls, answer: F.struct(turn.cast("long").alias("turn"), role.alias("role"), content.cast("string").alias("content"), calls.cast("array<struct<id: string>>").alias("tool_calls"), answer.cast("string").alias("tool_call_id"))
    first = turn(F.lit(0), F.when(key % 7 == 0, "robot").otherwise("user"), F.when(key % 7 != 1, "hi"), none, none)
    asks = turn(F.lit(1), F.lit("assistant"), none, F.transform("lines", lambda n: F.struct(call(n).alias("id"))), none)
    answers = F.transform("lines", lambda n: turn(1 + n, F.lit("tool"), F.lit("r"), none, F.when(n % 4 == 3, F.concat(F.lit("x"), n.cast("string"))).otherwise(call(n))))
    again = F.transform(F.filter("lines", lambda n: (n % 4 == 2) & (key % 5 == 0)), lambda n: turn(101 + n, F.lit("tool"), F.lit("r"), none, call(n)))
    last = turn(F.lit(300), F.lit("assistant"), F.when(key % 3 == 2, "done"), F.when(key % 3 == 1, F.array().cast("array<struct<id: string>>")), none)
    return contracts.messages(cases.select("case_id", F.inline(F.concat(F.array(first, asks), answers, again, F.array(last)))))


@query("""SELECT 'complete run is interrupted or provisional' AS rule, c_custkey::VARCHAR AS key, (c_custkey % 3)::VARCHAR AS detail FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 5 = 0 OR c_custkey % 3 > 0)""")
def run_rules(spark, d):
    c = F.col("c_custkey")
    return contracts.run_complete(table(spark, d, "customer").select(c.alias("run_id"), (c % 2 == 0).alias("complete"), F.when(c % 5 == 0, "timeout").alias("interruption"), (c % 3).alias("provisional")))


@query("""WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 AND l_orderkey % 6 = 0 THEN 99 ELSE l_linenumber END AS ord FROM lineitem),
    b AS (SELECT *, lag(ord) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM o)
    SELECT 'out of order' AS rule, l_orderkey || '-' || l_linenumber AS key, ord::VARCHAR AS detail FROM b WHERE before > ord""")
def trial_order(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    t = li.select(text("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("trial_index"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("nodeid"), F.when((F.col("l_linenumber") == 2) & (F.col("l_orderkey") % 6 == 0), 99).otherwise(F.col("l_linenumber")).alias("ord"))
    return contracts.ordered(t, "ord")


@query("""WITH t AS (SELECT group_id, case_id, trial_index, status FROM trials), g AS (SELECT DISTINCT group_id FROM t WHERE status <> 'skipped')
    SELECT 'embedded trial unknown' AS rule, group_id || '::0' AS key, group_id AS detail FROM g WHERE group_id::BIGINT % 4 = 0
    UNION ALL SELECT 'trial not embedded', group_id || '::' || trial_index, group_id FROM t WHERE status <> 'skipped' AND group_id::BIGINT % 4 = 1 AND trial_index = 1""", "trials")
def embedded_trials(spark, d):
    """Aggregates of which some embed an unknown trial and some lack their first."""
    t = trials(spark, d).select("group_id", "case_id", "nodeid", "trial_index", "status")
    g = F.col("group_id").cast("long")
    kept = t.filter((F.col("status") != "skipped") & ((g % 4 != 1) | (F.col("trial_index") != 1)))
    extra = t.filter("status <> 'skipped'").select("group_id", "case_id").distinct().filter(g % 4 == 0).withColumn("nodeid", F.concat("group_id", F.lit("::0")))
    a = kept.select("group_id", "case_id", "nodeid").unionByName(extra).groupBy("group_id", "case_id").agg(F.collect_list("nodeid").alias("nodeids"))
    return contracts.nested_trials(a, t)


VERDICT_OF = """WITH g AS (SELECT group_id, max(configured_trials) AS configured, count(*) FILTER (status <> 'skipped') AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed,
    count(*) FILTER (status = 'error') AS errored, count(*) FILTER (status = 'skipped') AS skipped, bool_or(coalesce(status <> 'skipped' AND failure_kind = 'timeout', false)) AS timed_out FROM trials GROUP BY group_id),
    v AS (SELECT group_id, CASE WHEN timed_out THEN 'error' WHEN total + skipped < configured THEN 'partial' WHEN errored > 0 THEN 'error' WHEN passed = total THEN 'pass' WHEN failed = total THEN 'fail' ELSE 'flaky' END AS verdict FROM g WHERE total > 0)"""


@query(VERDICT_OF + """ SELECT 'aggregate missing' AS rule, group_id AS key, verdict AS detail FROM v WHERE group_id::BIGINT % 7 = 0 UNION ALL SELECT 'aggregate not derived', group_id, 'stale' FROM v WHERE group_id::BIGINT % 7 = 0""", "trials")
def derived_aggregates(spark, d):
    """Stored verdicts, a seventh of them stale."""
    t = trials(spark, d)
    stored = scoring.verdicts(t).withColumn("verdict", F.when(F.col("group_id").cast("long") % 7 == 0, "stale").otherwise(F.col("verdict")))
    return contracts.derived_equal(t, stored)


@query("""SELECT 'latency missing' AS rule, 'latency' AS key UNION ALL SELECT 'latency not derived', 'latency'""")
def derived_summary(spark, d):
    """A stored summary whose latency alone is stale."""
    t = trials(spark, d)
    stored = scoring.run_summary(t)
    stored["latency"] = stored["latency"].withColumn("latency_mean_ms", F.col("latency_mean_ms") + 1)
    return contracts.summary_equal(t, stored).select("rule", "key")


@query("""WITH i AS (SELECT n, CASE WHEN n % 5 = 0 THEN 'Bad ' || n ELSE 'idea-' || n END AS id, ['pending', 'approved', 'done'][(n % 3)::INT + 1] AS status FROM (SELECT c_custkey AS n FROM customer))
    SELECT 'bad id' AS rule, id AS key, status AS detail FROM i WHERE n % 5 = 0 UNION ALL SELECT 'no trace ids', id, status FROM i WHERE n % 4 = 0 UNION ALL SELECT 'blank trace id', id, status FROM i WHERE n % 4 = 1
    UNION ALL SELECT 'unknown status', id, status FROM i WHERE n % 3 = 2 UNION ALL SELECT 'no source', id, status FROM i WHERE n % 7 = 0""")
def idea_rules(spark, d):
    n = F.col("c_custkey")
    ids = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("t"), F.lit(" "))).otherwise(F.array(F.lit("t")))
    rows = table(spark, d, "customer").select(F.when(n % 5 == 0, F.concat(F.lit("Bad "), text("c_custkey"))).otherwise(F.concat(F.lit("idea-"), text("c_custkey"))).alias("id"), ids.alias("trace_ids"), pick(n, "pending", "approved", "done").alias("status"), F.when(n % 7 == 0, " ").otherwise("s").alias("source"))
    return contracts.ideas(rows)


@query("""SELECT 'fingerprint differs' AS rule, c_custkey::VARCHAR AS key, 'sha256:' || sha256('["' || lower(c_name) || '","x"]') AS detail FROM customer WHERE c_custkey % 3 = 0""")
def fingerprint_rules(spark, d):
    """Stored fingerprints, a third of them of another text."""
    now = queues.fingerprint(F.concat(F.lit(" "), F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.lit("Y")).otherwise(F.lit("x")))
    rows = table(spark, d, "customer").select(text("c_custkey").alias("id"), "c_name", "c_custkey", queues.fingerprint(F.upper("c_name"), F.lit(" X ")).alias("semantic_fingerprint"))
    return contracts.fingerprints_equal(rows, now)


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord FROM events), s AS (SELECT *, CASE WHEN ord % 7 = 0 THEN ord - 1 ELSE ord END AS seq, CASE WHEN event_id % 11 = 0 THEN 'same' ELSE event_id::VARCHAR END AS id FROM e),
    b AS (SELECT *, lag(seq) OVER (PARTITION BY user_id ORDER BY ord) AS before FROM s)
    SELECT 'sequence does not increase' AS rule, user_id || '/' || id AS key, seq::VARCHAR AS detail FROM b WHERE seq <= before
    UNION ALL SELECT 'own parent', user_id || '/' || id, seq::VARCHAR FROM b WHERE event_id % 13 = 0 UNION ALL SELECT 'ends before start', user_id || '/' || id, seq::VARCHAR FROM b WHERE event_id % 17 = 0
    UNION ALL SELECT 'repeated event id', user_id || '/same', count(*)::VARCHAR FROM b WHERE id = 'same' GROUP BY user_id HAVING count(*) > 1""")
def agent_run_rules(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("ord"))
    id_ = F.when(F.col("event_id") % 11 == 0, "same").otherwise(text("event_id"))
    rows = e.select(text("user_id").alias("run_id"), id_.alias("id"), "ord", F.when(F.col("ord") % 7 == 0, F.col("ord") - 1).otherwise(F.col("ord")).alias("sequence"), F.when(F.col("event_id") % 13 == 0, id_).otherwise("root").alias("parent_id"), F.lit(10).alias("started_at"), F.when(F.col("event_id") % 17 == 0, 9).otherwise(10).alias("ended_at"))
    return contracts.agent_runs(rows)


@query("""WITH r AS (SELECT c_custkey AS n, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS complete, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'cut' END AS reason FROM customer)
    SELECT CASE WHEN complete AND reason IS NOT NULL THEN 'reason not wanted' WHEN NOT complete AND reason IS NULL THEN 'reason missing' ELSE 'blank reason' END AS rule, n::VARCHAR AS key, reason AS detail FROM r
    WHERE complete AND reason IS NOT NULL OR NOT complete AND reason IS NULL OR trim(reason) = ''""")
def run_completeness(spark, d):
    n = F.col("c_custkey")
    word = lambda k: F.when(n % k == 0, "complete").otherwise("partial")
    return contracts.run_completeness(table(spark, d, "customer").select(n.alias("run_id"), word(2).alias("trajectory_completeness"), word(3).alias("state_completeness"), F.when(n % 4 == 1, " ").when(n % 4 > 1, "cut").alias("incomplete_reason")))


@query("""WITH j AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS passed, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'why' END AS reasoning, c_custkey % 11 = 0 AS error FROM customer),
    k AS (SELECT *, CASE WHEN passed IS NULL OR trim(reasoning) = '' THEN 'contract' WHEN error THEN 'execution' WHEN NOT passed THEN 'assertion' ELSE 'ok' END AS kind FROM j)
    SELECT n, kind, CASE kind WHEN 'ok' THEN 'pass' WHEN 'assertion' THEN 'fail' ELSE 'error' END AS status, CASE kind WHEN 'ok' THEN NULL WHEN 'assertion' THEN 'agent' ELSE 'judge' END AS category,
    ['pass', 'pass', 'error', 'fail'][(n % 4)::INT + 1] AS by_setting FROM k""")
def judge_outcomes(spark, d):
    n = F.col("n")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("n")).select("n", F.when(n % 5 != 0, n % 2 == 0).alias("passed"), F.when(n % 7 == 0, " ").otherwise("why").alias("reasoning"), (n % 11 == 0).alias("error"))
    return contracts.judge_results(rows).select("n", "kind", "status", "category", contracts.env_judge(pick(n, " Yes ", "1", "ERROR", "no")).alias("by_setting"))


def _row(n: Column) -> Column:
    """A case's row as JSON, in one of five shapes."""
    id_ = F.concat(F.lit('{"id":"'), n.cast("string"), F.lit('"'))
    rest = pick(n, ',"input":{"q":1},"x":2}', ',"messages":[{"role":"user"}]}', ',"only":"one"}', ',"a":1,"b":[2]}', ',"input":null,"messages":[]}')
    return F.concat(id_, rest)


@query("""SELECT c_custkey, ['{"q":1}', '[{"role":"user"}]', '"one"', '{"a":1,"b":[2]}', 'null'][(c_custkey % 5)::INT + 1] AS input FROM customer""")
def case_inputs(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", payloads.case_input(F.parse_json(_row(F.col("c_custkey")))).alias("input"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'no id' WHEN 1 THEN 'both input and messages' END AS rule FROM customer WHERE c_custkey % 3 < 2""")
def case_rules(spark, d):
    n = F.col("c_custkey")
    cases = table(spark, d, "customer").select(F.when(n % 3 == 0, "").otherwise(text("c_custkey")).alias("id"), F.lit(True).alias("has_input"), (n % 3 == 1).alias("has_messages"), n)
    one = lambda part: contracts.case_rows(part).join(part.select(F.col("id").alias("key"), "c_custkey").filter("key <> ''"), "key")
    both = one(cases.filter("id <> ''")).select("c_custkey", "rule")
    return both.unionByName(cases.filter("id = ''").select("c_custkey", F.lit("no id").alias("rule")))


@query("""SELECT c_custkey, 't.py::test_' || c_custkey || CASE c_custkey % 4 WHEN 3 THEN '[a]' ELSE '' END AS group_id, CASE c_custkey % 3 WHEN 0 THEN 'inner' WHEN 1 THEN 'case' ELSE 'unknown' END AS case_id FROM customer""")
def trial_identities(spark, d):
    n = F.col("c_custkey")
    node = F.concat(F.lit("t.py::test_"), text("c_custkey"), pick(n, "[trial3]", "", "[trial12]", "[a-trial2]"))
    case = payloads.case_id(F.when(n % 3 == 0, "inner").otherwise(""), F.when(n % 3 == 1, "case"), F.lit(""))
    return table(spark, d, "customer").select("c_custkey", payloads.group_id(node).alias("group_id"), case.alias("case_id"))


@query("""SELECT event_id, event_id % 5 < 4 AS recorded, CASE event_id % 5 WHEN 0 THEN '{"k":' || json_extract_string(props, '$.k') || '}' WHEN 1 THEN '[1,"a"]' WHEN 2 THEN '"NaN"' WHEN 3 THEN 'null' END AS arguments FROM events""")
def tool_payloads(spark, d):
    """Canonical, attached and flat payloads, JSON in a text decoded once."""
    n = F.col("event_id")
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    shape = F.when(n % 5 == 0, F.concat(F.lit('{"agent.tool.args":'), quoted, F.lit(',"arguments":9}')))
    shape = shape.when(n % 5 == 1, F.lit('{"agent.evidence.source":"agent_run","input":[1,"a"],"arguments":9}')).when(n % 5 == 2, F.lit('{"input":7,"arguments":"NaN"}')).when(n % 5 == 3, F.lit('{"arguments":null}')).otherwise(F.lit('{"input":7}'))
    s = table(spark, d, "events").select("event_id", "props", F.parse_json(shape).alias("attributes"))
    return payloads.with_tool_payloads(s).select("event_id", F.col("arguments_recorded").alias("recorded"), F.when(F.col("arguments_recorded"), F.to_json("arguments")).alias("arguments"))


@query("""SELECT event_id::VARCHAR AS span_id, CASE WHEN event_type = 'click' THEN 'click' END AS tool_name, ['ok', 'error', 'cancelled'][(event_id % 3)::INT + 1] AS status, 'agent_run' AS source, CASE WHEN event_id % 2 = 0 THEN 'given' END AS input, 'x' AS kept, 4::BIGINT + (event_id % 2 = 0)::BIGINT + 3 AS attributes FROM events""")
def agent_event_spans(spark, d):
    n = F.col("event_id")
    own = F.create_map(F.lit("input"), F.lit("forged"), F.lit("agent.agent.run_id"), F.lit("forged"), F.lit("own"), F.lit("x"))
    e = table(spark, d, "events").select(F.lit("r").alias("run_id"), F.lit("v1").alias("revision"), F.lit("test").alias("environment"), F.lit("none").alias("effects"), n.alias("sequence"), text("event_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "click", "tool").otherwise("step").alias("kind"), pick(n, "completed", "failed", "cancelled").alias("status"), F.lit(1).alias("started_at"), F.lit(2).alias("ended_at"), own.alias("attributes"), F.when(n % 2 == 0, "given").alias("input"), F.lit(None).cast("string").alias("output"))
    s = payloads.event_spans(e)
    return s.select("span_id", "tool_name", "status", F.col("attributes")["agent.evidence.source"].alias("source"), F.col("attributes")["input"].alias("input"), F.col("attributes")["own"].alias("kept"), F.size("attributes").cast("long").alias("attributes"))


@query("""WITH c AS (SELECT trace_id, span_id, status, json_extract(props, '$.k')::BIGINT AS k FROM spans WHERE tool_name = 'click'), t AS (SELECT DISTINCT trace_id FROM spans WHERE tool_name IS NOT NULL)
    SELECT trace_id, trace_id IN (SELECT trace_id FROM c WHERE k < 10 AND k % 10 = 3) AS called FROM t""", "spans")
def tool_called(spark, d):
    calls = traces.tool_calls(spans(spark, d)).withColumns({"arguments": F.try_parse_json("props"), "arguments_recorded": F.lit(True)})
    return traces.called(calls, "click", arguments={"k": 3})


@query("""WITH n AS (SELECT trace_id, string_agg(tool_name, ',' ORDER BY started_at, span_id) AS tools FROM spans WHERE tool_name IS NOT NULL GROUP BY trace_id)
    SELECT trace_id, coalesce(any_value(tools), '') AS tools, round(sum(cost_usd), 6) AS known_cost, count(*) FILTER (kind = 'llm') AS llm_turns, round((max(ended_at) - min(started_at)) / 1e6::DOUBLE, 6) AS duration_ms FROM spans LEFT JOIN n USING (trace_id) GROUP BY trace_id""", "spans")
def trace_documents(spark, d):
    t = traces.trace_documents(spans(spark, d))
    return t.select("trace_id", F.array_join("tools", ",").alias("tools"), F.round("known_cost", 6).alias("known_cost"), "llm_turns", F.round("duration_ms", 6).alias("duration_ms"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'llm' END AS explicit, CASE WHEN event_id % 7 = 0 THEN 'find' END AS tool, [NULL, 'chat', 'execute_tool'][(event_id % 3)::INT + 1] AS operation, event_id % 2 = 0 AS has FROM events)
    SELECT event_id, coalesce(explicit, CASE WHEN tool IS NOT NULL THEN 'tool' WHEN operation = 'chat' THEN 'llm' WHEN operation IS NOT NULL THEN 'span' WHEN has THEN 'llm' ELSE 'span' END) AS kind,
    explicit IS NULL AND tool IS NULL AND coalesce(operation = 'chat', has) AS generative FROM e""")
def generative_spans(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(n % 5 == 0, "llm").alias("explicit_kind"), F.when(n % 7 == 0, "find").alias("tool_name"), F.when(n % 3 == 1, "chat").when(n % 3 == 2, "execute_tool").alias("operation"), (n % 2 == 0).alias("has_genai"))
    hits = traces.generative_spans(e).select("event_id", F.lit(True).alias("hit"))
    return e.join(hits, "event_id", "left").select("event_id", expr.runtime_kind(F.col("explicit_kind"), F.col("tool_name"), F.col("operation"), F.col("has_genai")).alias("kind"), F.coalesce("hit", F.lit(False)).alias("generative"))


@query("""SELECT 'API_URL_' || c_custkey AS key FROM customer WHERE c_custkey % 5 IN (0, 4)""")
def remote_endpoints(spark, d):
    n = F.col("c_custkey")
    value = pick(n, "https://u:p@api.example.com:8443/x", "http://localhost:3", "ftp://api.example.com", "http://box.local", "HTTPS://[2001:db8::1]/")
    return payloads.remote_endpoints(table(spark, d, "customer").select(F.concat(F.lit("API_URL_"), text("c_custkey")).alias("key"), value.alias("value")))


@query("""WITH a AS (SELECT c_custkey AS n FROM customer)
    SELECT n::VARCHAR AS nodeid, n % 3 = 0 OR n % 4 = 0 AS known, CASE WHEN n % 3 = 0 THEN 'snapshot' WHEN n % 4 = 0 THEN 'stored' END AS output, 'error' AS status, true AS incomplete FROM a""")
def timed_out_trials(spark, d):
    c = table(spark, d, "customer").select(text("c_custkey").alias("nodeid"), F.col("c_custkey").alias("n"))
    side = lambda k, word: c.filter(F.col("n") % k == 0).select("nodeid", F.lit(word).alias("output"))
    return queues.timed_out(c.select("nodeid"), side(4, "stored"), side(3, "snapshot"))


@query("""WITH b AS (SELECT c_custkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 4 <> 0)
    SELECT coalesce(b.n, a.n)::VARCHAR AS path, CASE WHEN b.n IS NULL THEN 'created' WHEN a.n IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM b FULL JOIN a ON a.n = b.n WHERE b.n IS NULL OR a.n IS NULL OR a.s <> b.s""")
def snapshot_changes(spark, d):
    c = table(spark, d, "customer").select(text("c_custkey").alias("path"), F.col("c_mktsegment").alias("digest"), F.col("c_custkey").alias("n"))
    after = c.filter("n % 4 <> 0").withColumn("digest", F.when(F.col("n") % 5 == 0, "X").otherwise(F.col("digest")))
    return queues.snapshot_diff(c.filter("n % 3 <> 0"), after)


@query("SELECT DISTINCT l_orderkey AS run_id, l_orderkey % 5 AS detail FROM lineitem")
def registered_runs(spark, d):
    """Evidence sent once a line item: equal duplicates count once."""
    return traces.register_runs(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") % 5).alias("detail")))


@query("SELECT l_orderkey AS trace_id, l_linenumber AS span_id, min(l_partkey) AS ord FROM lineitem GROUP BY l_orderkey, l_linenumber")
def span_dedup(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_partkey").alias("ord"))
    return traces.dedup_spans(li)


@query("""SELECT c_custkey, ['[REDACTED]', 'agent.run', '[REDACTED]', '[REDACTED]', repeat('z', 63) || '…'][(c_custkey % 5)::INT + 1] AS beat, CASE c_custkey % 4 WHEN 0 THEN 'a  b' WHEN 1 THEN NULL WHEN 2 THEN repeat('é', 297) || '...' ELSE repeat('é', 300) END AS hint,
    array_to_string(['my', 'key', c_custkey::VARCHAR], '_') AS tokens, '{"a":' || c_custkey || ',"b":[1,{"c":null}]}' AS canonical, CASE WHEN c_custkey >= 60 THEN (c_custkey // 60) || 'm ' || lpad(printf('%.1f', (c_custkey % 60)::DOUBLE), 4, '0') || 's' ELSE printf('%.1f', c_custkey::DOUBLE) || 's' END AS duration,
    CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_custkey::VARCHAR ELSE (c_custkey + 0.5)::DOUBLE::VARCHAR END AS timeout FROM customer""")
def text_helpers(spark, d):
    n = F.col("c_custkey")
    beat = pick(n, "no good!", "agent.run", "my-secret", "f" * 300, "z" * 80)
    hint = pick(n, " a\t​\nb ", " \n", "é" * 301, "é" * 300)
    canonical = F.concat(F.lit('{"b": [1, {"c": null}], "a": '), text("c_custkey"), F.lit("}"))
    seconds = payloads.valid_timeout(F.when(n % 3 == 0, float("inf")).when(n % 3 == 1, n.cast("double")).otherwise(n + 0.5))
    return table(spark, d, "customer").select("c_custkey", expr.heartbeat_text(beat).alias("beat"), payloads.body_hint(hint).alias("hint"), F.array_join(expr.name_tokens(F.concat(F.lit("My-Key."), text("c_custkey"))), "_").alias("tokens"), payloads.canonical_json(canonical).alias("canonical"), expr.format_duration(n.cast("double")).alias("duration"), payloads.timeout_text(seconds).alias("timeout"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AND CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS again, ['rejected the credentials', 'rate limited the caller', 'returned HTTP 500'][(c_custkey % 3)::INT + 1] AS reason,
    CASE WHEN c_custkey % 2 = 0 THEN 5.0 ELSE 7.0 END AS elapsed, ['3.8.1', '3.9.0', '3.10'][(c_custkey % 3)::INT + 1] = '3.8.1' AS fits, 'x' AS kept, 'explicit' AS won FROM customer""")
def error_helpers(spark, d):
    n = F.col("c_custkey")
    statuses = F.when(n % 4 == 0, F.array(F.lit(404), F.lit(503))).when(n % 4 == 1, F.array(F.lit(404))).otherwise(F.array().cast("array<int>"))
    names = F.when(n % 4 == 2, F.array(F.lit("RateLimit"))).otherwise(F.array(F.lit("Other")))
    flat = payloads.flat_attributes(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("nested")), F.create_map(F.lit("b"), F.lit("explicit")))
    elapsed = queues.elapsed_ms(F.lit(10_000_000), F.lit(3_000_000), F.lit(5_000_000), F.when(n % 2 == 0, "call").otherwise("setup"))
    return table(spark, d, "customer").select("c_custkey", payloads.retryable(statuses, names, ("RateLimit",), n % 3 == 0).alias("again"), payloads.http_reason(pick(n, 401, 429, 500)).alias("reason"), elapsed.alias("elapsed"), payloads.satisfies(pick(n, "3.8.1", "3.9.0", "3.10"), ">=3.8,<3.9").alias("fits"), flat["a"].alias("kept"), flat["b"].alias("won"))


@query("""WITH s AS (SELECT CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, c_custkey % 5 = 0 AS by_case, c_custkey % 7 = 0 AS by_node, c_custkey FROM customer)
    SELECT c_custkey, coalesce(flag, by_case OR by_node) AS smoke FROM s""")
def smoke_trials(spark, d):
    n = F.col("c_custkey")
    flag = F.when(n % 4 == 0, True).when(n % 4 == 1, False)
    return table(spark, d, "customer").select("c_custkey", scoring.is_smoke(flag, F.when(n % 5 == 0, scoring.SMOKE_CASE).otherwise("other"), F.when(n % 7 == 0, "a/b.py::test_smoke[x]").otherwise("a/b.py::test_smoked")).alias("smoke"))


@query("""WITH s AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT c_custkey AS n FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(s.n, f.n)::VARCHAR AS nodeid, CASE WHEN s.n IS NOT NULL AND s.n % 5 > 0 THEN 'pass' WHEN f.n IS NOT NULL THEN 'fail' ELSE 'provisional' END AS status, CASE WHEN f.n IS NOT NULL THEN 'fresh' WHEN s.n IS NOT NULL THEN 'old' END AS output FROM s FULL JOIN f ON s.n = f.n""")
def merged_snapshots(spark, d):
    """Fresh snapshots: final rows take their payload, provisional ones are replaced."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("n"), text("c_custkey").alias("nodeid"))
    stored = c.filter("n % 3 <> 0").select("nodeid", F.when(F.col("n") % 5 > 0, "pass").otherwise("provisional").alias("status"), F.lit("old").alias("output"))
    fresh = c.filter("n % 2 = 0").select("nodeid", F.lit("fail").alias("status"), F.lit("fresh").alias("output"))
    return scoring.snapshot_merge(stored, fresh, ["output"])


def _responses(spark, d) -> DataFrame:
    """Recorded dialogues: user turns as the simulator's; every fifth case ends by the agent's reason."""
    c = table(spark, d, "conversations").filter("role in ('user', 'assistant')")
    agent = F.col("role") == "assistant"
    k = F.col("conv_id") + F.col("turn")
    return c.select(F.col("conv_id").alias("case_id"), "turn", F.when(agent, "agent").otherwise("simulator").alias("source"), F.when(~agent | (k % 3 != 0), F.col("text")).alias("content"), F.when(agent & (k % 4 == 0), F.lit("stated")).alias("output"), (agent & (k % 4 == 0)).alias("has_output"), F.when(agent & (k % 5 == 0), "done").alias("reason"), (k % 11 == 0).alias("error"))


RESPONSES_SQL = """WITH r AS (SELECT conv_id AS case_id, turn, CASE WHEN role = 'assistant' THEN 'agent' ELSE 'simulator' END AS source, CASE WHEN role = 'user' OR (conv_id + turn) % 3 <> 0 THEN text END AS content,
    role = 'assistant' AND (conv_id + turn) % 4 = 0 AS has_output, CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN 'done' END AS reason, (conv_id + turn) % 11 = 0 AS error FROM conversations WHERE role IN ('user', 'assistant')),
    o AS (SELECT *, CASE WHEN has_output THEN 'stated' WHEN source = 'agent' THEN content END AS said FROM r)"""


@query(RESPONSES_SQL + """ SELECT case_id, turn, source, CASE WHEN content IS NOT NULL THEN CASE WHEN source = 'agent' THEN 'assistant' ELSE 'user' END END AS role, content,
    last_value(said IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY turn) AS output, reason FROM o""")
def dialogue_turns(spark, d):
    return conversations.folded_turns(_responses(spark, d))


@query(RESPONSES_SQL + """, g AS (SELECT case_id, count(content) AS messages, count(*) FILTER (source = 'agent') AS agent_turns, arg_max(said, turn) FILTER (said IS NOT NULL) AS output, arg_min(source, turn) FILTER (reason IS NOT NULL) AS by_, arg_min(reason, turn) FILTER (reason IS NOT NULL) AS why FROM o GROUP BY case_id)
    SELECT case_id, messages, agent_turns, output, coalesce(by_, CASE WHEN agent_turns >= 3 THEN 'engine' END) AS ended_by, coalesce(why, CASE WHEN agent_turns >= 3 THEN 'max_turns' END) AS reason FROM g""")
def dialogue_results(spark, d):
    return conversations.results(_responses(spark, d), 3)


@query(RESPONSES_SQL + """ SELECT 'neither content nor reason' AS rule, case_id || '/' || turn AS key, source AS detail FROM o WHERE content IS NULL AND reason IS NULL UNION ALL SELECT 'blank content', case_id || '/' || turn, source FROM o WHERE trim(content) = ''""")
def dialogue_rules(spark, d):
    return conversations.response_rules(_responses(spark, d))


@query(RESPONSES_SQL + """, k AS (SELECT *, CASE WHEN error THEN 'execution' WHEN trim(content) = '' OR content IS NULL AND reason IS NULL THEN 'contract' END AS kind FROM o)
    SELECT case_id, arg_min(source, turn) AS source, arg_min(kind, turn) AS kind FROM k WHERE kind IS NOT NULL GROUP BY case_id""")
def dialogue_failures(spark, d):
    return conversations.failure_kind(_responses(spark, d))


@query("""SELECT event_id, json_type(props, '$.k') = 'UBIGINT' AND json_extract(props, '$.k')::BIGINT % 2 = 1 AS same FROM events""")
def array_containment(spark, d):
    """Arrays compare element by element, whatever the script, key order or type."""
    k = F.get_json_object("props", "$.k").cast("long")
    doc = F.when(k % 2 == 1, F.lit('{"a": ["é", {"y": 1, "x": null}, 1.5]}')).otherwise(F.lit('{"a": ["é", {"y": 1.0, "x": null}, 1.5]}'))
    same = traces.contains_json(F.parse_json(doc), {"a": ["é", {"x": None, "y": 1}, 1.5]})
    return table(spark, d, "events").select("event_id", F.coalesce(same, F.lit(False)).alias("same"))


@query("""WITH e AS (SELECT * FROM (SELECT *, CASE WHEN status IN ('pass', 'fail') OR status = 'error' AND failure_category = 'agent' THEN true ELSE false END AS ok FROM trials) WHERE ok AND NOT smoke),
    k AS (SELECT group_id, trial_index, trial_index % 4 AS form, cost_usd, llm_turns, failure_kind FROM e),
    o AS (SELECT *, CASE WHEN form = 1 THEN cost_usd WHEN form = 2 THEN cost_usd / 2 WHEN form = 3 THEN cost_usd / 2 END AS known FROM k)
    SELECT group_id, trial_index, true AS relevant, CASE WHEN form = 1 THEN cost_usd IS NOT NULL WHEN form IN (2, 3) THEN false ELSE coalesce(cost_usd <> 0, false) END AS complete,
    round(CASE WHEN form = 1 THEN cost_usd WHEN form IN (2, 3) THEN known ELSE CASE WHEN cost_usd <> 0 THEN cost_usd END END, 9) AS observed_cost FROM o""", "trials")
def cost_forms(spark, d):
    """Costs told as available, as not available, by their known part, and in the old form."""
    t = scoring.eligible(trials(spark, d))
    form = F.col("trial_index") % 4
    t = t.withColumns({"cost_available": F.when(form == 1, True).when(form == 2, False), "known_cost_usd": F.when(form == 1, F.col("cost_usd")).when(form > 1, F.col("cost_usd") / 2), "has_known_cost": form == 3})
    return scoring.cost_observation(t).select("group_id", "trial_index", "relevant", "complete", F.round("observed_cost", 9).alias("observed_cost"))


@query("""SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN 'trials below 1' ELSE 'timeout not positive and finite' END AS rule FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey::VARCHAR, 'timeout not positive and finite' FROM customer WHERE c_custkey % 4 = 1""")
def marker_rules(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select(text("c_custkey").alias("nodeid"), F.when(n % 3 == 0, 0).otherwise(2).alias("trials"), F.when(n % 4 == 0, 5.0).when(n % 4 == 1, float("inf")).alias("timeout_s"))
    return contracts.markers(rows).select("key", "rule")


@query("""SELECT c_custkey AS n, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 2 = 0 AS passed, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'the judge''s result breaks its contract' ELSE 'why' END AS reasoning, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS error, 'm' AS model FROM customer""")
def judge_snapshots(spark, d):
    n = F.col("n")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("n")).select("n", F.when(n % 5 != 0, n % 2 == 0).alias("passed"), F.when(n % 7 == 0, " ").otherwise(" why ").alias("reasoning"), F.lit(None).cast("boolean").alias("error"), F.lit("m").alias("model"))
    return contracts.judge_snapshots(rows)


@query("""WITH n AS (SELECT trace_id, list(tool_name) AS names FROM spans WHERE tool_name IS NOT NULL GROUP BY trace_id)
    SELECT trace_id, 'buys' AS check, list_contains(names, 'purchase') AS passed FROM n UNION ALL SELECT trace_id, 'few', len(names) < 40 FROM n""", "spans")
def trace_assertions(spark, d):
    names = traces.tool_names(traces.tool_calls(spans(spark, d)))
    return contracts.assertions(names, {"buys": traces.include(F.col("names"), ["purchase"]), "few": F.size("names") < 40})


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def publishable_snapshots(spark, d):
    n = F.col("c_custkey")
    return contracts.publishable(table(spark, d, "customer").select("c_custkey", (n % 2 == 0).alias("output_recorded"), (n % 3 == 0).alias("trace_only"))).select("c_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def earliest_deadline(spark, d):
    seconds = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", (seconds + F.col("o_orderkey") / F.lit(1e6)).alias("started"), F.lit(1.0).alias("timeout_s"))
    return queues.earliest_deadline(t).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'harness' ELSE ['simulator', 'judge', 'agent', 'agent'][(c_custkey % 4)::INT + 1] END AS category, CASE WHEN c_custkey % 3 = 0 THEN 'setup' ELSE 'timeout' END AS kind FROM customer""")
def timeout_failures(spark, d):
    n = F.col("c_custkey")
    phase, operation = pick(n, "setup", "call", "call"), F.when(n % 4 < 3, pick(n, "simulator", "judge", "llm", "none"))
    return table(spark, d, "customer").select("c_custkey", queues.timeout_failure(phase, operation).alias("category"), queues.timeout_kind(phase).alias("kind"))
