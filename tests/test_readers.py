import json

import pytest

from trialscope.sources import readers


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_span_rows_group_in_file_order(spark, tmp_path):
    rows = [
        {"trace_id": "b", "span_id": "1", "name": "first", "kind": "LLM", "start_time_unix_nano": 2000000, "end_time_unix_nano": 3000000, "status": "ok", "attributes": {"gen_ai.usage.input_tokens": 5, "gen_ai.usage.output_tokens": "7", "acme.cost_usd": 0.25, "secret": "x"}},
        {"traceId": "a", "spanId": "1", "parentSpanId": "0", "toolName": "", "attributes": {"tool.name": "search"}, "startTime": "2026-01-02T03:04:05.123456Z", "status": True},
        {"trace_id": "b", "span_id": "2", "name": "second", "start_time_unix_nano": "1000000", "status": "no failures", "output": None, "outputs": {"x": [1, 2]}},
    ]
    e = readers.read(spark, "JSONL", write(tmp_path, "spans.jsonl", "\n\n".join(map(json.dumps, rows))), "acme")
    spans = {(r.trace_id, r.span_id): r for r in e.spans.collect()}
    first = spans["b", "1"]
    assert (first.kind, first.usage.total_tokens, first.usage.cost_usd, first.duration_ms) == ("llm", 12, 0.25, 1.0)
    tool = spans["a", "1"]
    assert (tool.kind, tool.tool_name, tool.name, tool.parent_id, tool.status) == ("tool", "search", "tool", "0", "error")
    assert tool.started_at == int(1767323045.123456 * 1e9)
    assert spans["b", "2"].status == "error"
    traces = {r.id: r for r in readers.trace_rows(e).collect()}
    assert (traces["b"].name, traces["b"].started_at, traces["b"].ended_at, traces["b"].status, traces["b"].span_count) == ("first", 1000000, 3000000, "error", 2)
    assert [r.id for r in readers.trace_rows(e, 1).collect()] == ["b"]


def test_trace_records_state_their_own_fields(spark, tmp_path):
    doc = {"traces": [{"id": "t", "name": "n", "status": "unset", "startTime": "2026-01-01T00:00:00", "input": {"b": 1, "a": None}, "spans": [{"id": "s", "end_time": "10", "status": "error"}, 5]}, "no object", {"traceId": "u", "spans": []}]}
    e = readers.read(spark, "json", write(tmp_path, "traces.json", json.dumps(doc)))
    rows = {r["id"]: r for r in readers.trace_rows(e).selectExpr("*", "to_json(input) AS text").collect()}
    assert rows["t"]["status"] == "ok" and rows["t"]["ended_at"] == 10 and rows["t"]["duration_ms"] == 0.0
    assert json.loads(rows["t"]["text"]) == {"a": None, "b": 1}
    assert rows["u"]["status"] == "unknown" and rows["u"]["span_count"] == 0


def test_otlp(spark, tmp_path):
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "call", "kind": 3, "startTimeUnixNano": "bad", "endTimeUnixNano": "9", "status": {"code": 2, "message": "m"}, "attributes": [{"key": "gen_ai.prompt", "value": {"stringValue": "hi"}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "4"}}, {"key": "other", "value": {"stringValue": "dropped"}}]}
    e = readers.read(spark, "otlp", write(tmp_path, "o.json", json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]})))
    r = e.spans.selectExpr("*", "to_json(input) AS text").first()
    assert (r.kind, r.status, r.parent_id, r.started_at, r.ended_at, r.usage.total_tokens, r.text) == ("3", "error", None, None, 9, 4, '"hi"')
    empty = readers.read(spark, "otlp", write(tmp_path, "e.json", '{"resourceSpans": {}}'))
    assert empty.spans.count() == 0


def test_otlp_values_nest(spark):
    nested = {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"kvlistValue": {"values": [{"key": "b", "value": {"arrayValue": {}}}, {"value": {}}]}}, {}, None]}}}]}}
    assert readers.untagged(nested) == {"a": ["1", {"b": []}, {}, None]} and readers.untagged(5) == 5 and readers.untagged({"other": 1}) == {"other": 1}


def test_observations_join_their_traces(spark, tmp_path):
    doc = {"traces": [{"id": "t", "observations": [{"id": "o1", "type": "TOOL", "name": "find"}]}], "observations": [{"id": "o2", "traceId": "t", "type": "GENERATION", "level": "ERROR", "usageDetails": {"input": 3, "total": 9}, "totalCost": 0.5, "providedModelName": "m"}, {"id": "o3", "traceId": "gone"}]}
    e = readers.read(spark, "langfuse", write(tmp_path, "l.json", json.dumps(doc)))
    rows = e.spans.orderBy("span_ord").collect()
    assert [(r.span_id, r.kind, r.tool_name) for r in rows] == [("o1", "tool", "find"), ("o2", "llm", None)]
    assert (rows[1].status, rows[1].usage.total_tokens, rows[1].usage.cost_usd, rows[1].usage.model) == ("error", 9, 0.5, "m")
    v2 = {"data": [{"id": "x", "traceId": "q", "traceName": "named", "type": "SPAN"}, {"id": "y", "traceId": "q", "traceName": "later"}]}
    e = readers.read(spark, "langfuse", write(tmp_path, "v2.json", json.dumps(v2)))
    assert [(r.id, r.name, r.span_count) for r in readers.trace_rows(e).collect()] == [("q", "named", 2)]


@pytest.mark.parametrize("text", ['{"trace_id": "t", "span_id": "s"}\n{"id": "r", "spans": []}', "{broken", '{"span_id": "s"}', '{"trace_id": "t", "span_id": ""}', '{"trace_id": "t", "span_id": "s"}\n{"trace_id": "t", "span_id": "s"}'])
def test_bad_input_fails(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        readers.trace_rows(readers.read(spark, "jsonl", write(tmp_path, "bad.jsonl", text))).collect()


def test_unknown_provider(spark):
    with pytest.raises(ValueError):
        readers.read(spark, "csv", "x")
