import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trialscope.operators import scoring
from trialscope.sources import artifacts, versions
from trialscope.streaming import live


def test_import_gate_and_tampering(spark, tmp_path):
    rows = [{"trace_id": "t", "span_id": str(i), "name": f"mail a{i % 2}@example.com", "input": {"q": "card 4111 1111 1111 1111"}, "status": "ok"} for i in range(4)]
    src = tmp_path / "s.jsonl"
    src.write_text("\n".join(map(json.dumps, rows)))
    out = str(tmp_path / "out")
    m = artifacts.import_traces(spark, "jsonl", str(src), out, key=b"k" * 32)
    assert m["redacted_span_count"] == 9 and m["trace_count"] == 1  # the trace takes its first span's name
    assert m["entity_instance_counts"] == {"CREDIT_CARD": 1, "EMAIL_ADDRESS": 2} and artifacts.warnings(m) == ["redaction changed 9 value(s)"]
    got = artifacts.load_traces(spark, out).collect()
    assert len(got) == 4 and all("example.com" not in r.name and "4111" not in r.input for r in got)
    spark.range(1).write.mode("append").json(f"{out}/{versions.version(spark, out).members['spans'][versions.WHOLE]}")
    with pytest.raises(artifacts.GateError):
        artifacts.load_traces(spark, out)
    with pytest.raises(ValueError):
        artifacts.import_traces(spark, "jsonl", str(src), out, max_bytes=10)
    with pytest.raises(artifacts.GateError):
        artifacts.load_traces(spark, str(tmp_path / "nowhere"))


def test_manifest_rules(spark):
    good = {"model": {"name": "patterns", "version": "1", "checksum_verified": True}, "version": artifacts.VERSION, "mandatory": True, "value_redaction_applied": True, "redaction_available": True, "ruleset_hash": "h", "language": "en", "pseudonymization": artifacts.SCHEME}
    assert artifacts.manifest_problem(good, "h") is None
    assert artifacts.manifest_problem({}) == "no manifest"
    for key in good:
        assert artifacts.manifest_problem(good | {key: None}, "h")
    model = good["model"]
    assert artifacts.manifest_problem(good | {"model": model | {"version": "2"}}, "h") == "unknown model"
    assert artifacts.manifest_problem(good | {"model": model | {"checksum_verified": False}}, "h") == "unverified model"
    assert artifacts.manifest_problem(good | {"language": "fr"}, "h") == "unsupported language"
    assert artifacts.manifest_problem(good | {"raw_source": True}, "h") == "raw source"


def test_since_and_pages():
    now = dt.datetime(2026, 1, 8, tzinfo=dt.UTC)
    assert artifacts.since("7d", now) == dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    assert artifacts.since("2026-01-01T00:00:00.5") == dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    assert artifacts.since("yesterday") == "yesterday"
    data = list(range(250))
    fetch = lambda page, size: {"data": [{"i": i} for i in data[(page - 1) * size : page * size]], "meta": {"totalPages": 3}}
    assert len(artifacts.pages(fetch, 1000)) == 250 and len(artifacts.pages(fetch, 120)) == 120
    with pytest.raises(ValueError):
        artifacts.pages(lambda p, s: {}, 5)


def finished(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    spans = [("a", at(0), "ok"), ("a", at(30), "error"), ("b", at(40), "ok"), ("z", at(90000), "ok")]
    spark.createDataFrame(spans, "trace_id string, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "spans"))
    stream = spark.readStream.schema("trace_id string, ts timestamp, status string").parquet(str(tmp_path / "spans"))
    got = {r.trace_id: (r.span_count, r.errors) for r in finished(spark, live.trace_sessions(stream), "sessions").collect()}
    assert got["a"] == (2, 1) and got["b"] == (1, 0)
    trials = [("g", "pass"), ("g", "fail"), ("h", "pass")]
    df = spark.createDataFrame(trials, "group_id string, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "trials"))
    stream = spark.readStream.schema("group_id string, status string").parquet(str(tmp_path / "trials"))
    rows = {tuple(r) for r in finished(spark, live.verdict_counts(stream), "counts", "complete").collect()}
    assert rows == {tuple(r) for r in live.verdict_counts(df).collect()}


def test_upsert_sink(spark, tmp_path):
    sink = live.upsert(str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "nodeid string, ord int, status string")
    sink(rows(("a", 1, "provisional"), ("b", 1, "pass")), 0)
    sink(rows(("a", 2, "pass")), 1)
    sink(rows(("a", 2, "pass")), 1)
    sink(rows(("c", 1, "fail")), 2)
    sink(rows().limit(0), 3)
    got = live.latest_rows(spark, str(tmp_path / "t"))
    assert {tuple(r) for r in got.select("nodeid", "status").collect()} == {("a", "pass"), ("b", "pass"), ("c", "fail")} and got.columns == ["nodeid", "ord", "status"]


def test_pass_k_numbers(spark):
    groups = spark.createDataFrame([("a", 2, 3), ("b", 1, 1)], "group_id string, passed long, total long")
    curve = {r.k: (round(r.value, 6), r.cohorts) for r in scoring.pass_k_curve(groups).collect()}
    assert curve == {1: (round(5 / 6, 6), 2), 2: (round(1 / 3, 6), 1), 3: (0.0, 1)}


def test_snapshot_merge(spark):
    stored = spark.createDataFrame([("a", "provisional", None), ("b", "pass", None)], "nodeid string, status string, output string")
    fresh = spark.createDataFrame([("a", "fail", "x"), ("b", "provisional", "y"), ("c", "provisional", "z")], stored.schema)
    got = {r.nodeid: (r.status, r.output) for r in scoring.snapshot_merge(stored, fresh, ["output"]).collect()}
    assert got == {"a": ("fail", "x"), "b": ("pass", "y"), "c": ("provisional", "z")}


def test_empty_run(spark):
    from trialscope.plans import adapters

    empty = adapters.trials(spark, "/root/testdata/sf0.001").filter(F.lit(False))
    s = scoring.run_summary(empty)
    assert s["latency"].first().asDict() == {"latency_p50_ms": 0.0, "latency_p95_ms": 0.0, "latency_mean_ms": 0.0}
    cost = s["cost"].first()
    assert cost.total_cost_usd is None and cost.cost_coverage == 0.0 and s["pass_k_curve"].count() == 0


def test_an_import_holds_no_raw_id_and_no_secret(spark, tmp_path):
    spans = [
        {"span_id": "raw-root", "name": "root", "start_time_unix_nano": 5, "usage": {"input_tokens": 4111111111111111}, "input": {"api_key": {"deep": [1, "x"]}, "bob@example.com": 1, "ann@example.com": 2, "n": 4111111111111111}},
        {"span_id": "raw-child", "parent_span_id": "raw-root", "name": "child", "output": ["call ann@example.com", {"password": "a b"}]},
        {"span_id": "raw-lost", "parent_span_id": "raw-gone", "name": "lost", "status_message": "dob 1990-01-02"},
    ]
    doc = {"traces": [{"id": "raw-trace", "name": "for ann@example.com", "input": {"authorization": 7}, "output": "fine", "spans": spans}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    out = str(tmp_path / "out")
    m = artifacts.import_traces(spark, "json", str(tmp_path / "t.json"), out, key=b"k" * 32, run_id="r1")
    assert m["secret_keys_redacted"] and m["span_count"] == 3
    s = {r.name: r for r in artifacts.load(spark, out).collect()}
    t = artifacts.load(spark, out, "traces").first()
    everything = json.dumps([[str(v) for v in r] for r in [*s.values(), t]])
    assert all(x not in everything for x in ("raw-", "example.com", "deep", "1990", "a b"))
    assert s["child"].parent_id == s["root"].span_id and s["lost"].parent_id is None and {r.trace_id for r in s.values()} == {t.id}
    assert (t.name, json.loads(t.input), t.output, t.import_run_id) == ("for [EMAIL_ADDRESS_1]", {"authorization": "[SECRET_1]"}, '"fine"', "r1")
    assert json.loads(s["root"].input) == {"api_key": "[SECRET_2]", "[EMAIL_ADDRESS_2]": 1, "[EMAIL_ADDRESS_1]": 2, "n": "[CREDIT_CARD_1]"}
    assert s["root"].usage.input_tokens == 4111111111111111 and json.loads(s["child"].output) == ["call [EMAIL_ADDRESS_1]", {"password": "[SECRET_3]"}]
    again = artifacts.import_traces(spark, "json", str(tmp_path / "t.json"), str(tmp_path / "again"), key=b"k" * 32)
    assert again["entity_instance_counts"] == m["entity_instance_counts"]
    assert {r.span_id for r in artifacts.load(spark, str(tmp_path / "again")).collect()} == {r.span_id for r in s.values()}


def test_keys_that_become_alike(spark):
    from trialscope.operators import documents

    doc = {"input": {"a@x.com": 1, "[EMAIL_ADDRESS_1]": 2, "p": {"token": None}}, "name": "", "n": True}
    df = spark.createDataFrame([(0, 0, [], json.dumps(doc)), (0, 1, [], None)], "trace_ord long, doc_ord long, path array<string>, doc string")
    out, leaves = documents.redact_documents(df)
    assert [json.loads(r.doc) for r in out.collect()] == [{"input": {"[EMAIL_ADDRESS_1]": 1, "[REDACTED_KEY_1]": 2, "p": {"token": "[SECRET_1]"}}, "name": "", "n": True}]
    assert documents.statistics(leaves) == {"redacted_span_count": 2, "changed_value_count": 2, "secret_keys_redacted": True, "entity_instance_counts": {"EMAIL_ADDRESS": 1, "SECRET": 1}}


def test_key_file(tmp_path):
    path = str(tmp_path / "keys" / "k")
    assert artifacts.pseudonym_key(path) == artifacts.pseudonym_key(path) and (tmp_path / "keys" / "k").stat().st_mode & 0o777 == 0o600
    (tmp_path / "bad").write_bytes(b"short")
    with pytest.raises(ValueError):
        artifacts.pseudonym_key(str(tmp_path / "bad"))


def test_runs_are_written_and_read_by_contract(spark, tmp_path):
    from trialscope.plans import adapters

    t = adapters.trials(spark, "/root/testdata/sf0.001").filter("group_id < 200 and status <> 'skipped'")
    out = str(tmp_path / "run")
    artifacts.write_run(t, out, "r")
    assert artifacts.load_run(spark, out).count() == t.count()
    with pytest.raises(ValueError):
        artifacts.write_run(t.withColumn("nodeid", F.lit("same")), out, "r")
    assert artifacts.load_run(spark, out).count() == t.count()  # the old run stays
    versions.replace(spark, out, {"aggregates": versions.read(spark, out, "aggregates").withColumn("passed", F.col("passed") + 1)})
    with pytest.raises(ValueError):
        artifacts.load_run(spark, out)
    assert artifacts.load_run(spark, out, 0).count() == t.count()


def test_pointers_captures_and_queues(spark, tmp_path):
    spans = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "trace_id string, span_id string")
    m = artifacts.write_spans(spans, str(tmp_path / "raw"), "r")
    assert (m["span_count"], m["trace_count"]) == (3, 2) and artifacts.manifest_problem(m) == "raw source"
    assert artifacts.capture_provider(spark, "jsonl", str(tmp_path / "raw/spans")) == "local-jsonl" == artifacts.capture_provider(spark, "jsonl", str(tmp_path / "raw/spans/part"))
    assert artifacts.capture_provider(spark, "jsonl", str(tmp_path / "other/x/y.jsonl")) == "jsonl"
    pointer = str(tmp_path / "latest.json")
    with pytest.raises(ValueError):
        artifacts.resolve_latest(spark, None, pointer)
    artifacts.write_latest(spark, pointer, "raw", m)
    assert artifacts.resolve_latest(spark, None, pointer) == str(tmp_path / "raw") and artifacts.resolve_latest(spark, "file:/x", pointer) == "/x"
    artifacts.write_latest(spark, pointer, "gone", m)
    with pytest.raises(ValueError):
        artifacts.resolve_latest(spark, None, pointer)
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.json").write_text('{"items": [{"id": "x"}, {"id": "y"}]}')
    (tmp_path / "q/b.json").write_text('{"items": 3}')
    (tmp_path / "q/c.json").write_text("{")
    (tmp_path / "q/old.md").write_text("# old")
    items, problems = artifacts.queue_files(spark, str(tmp_path / "q"), json.loads)
    assert sorted((r.file, r["item"]) for r in items.collect()) == [("a.json", '{"id": "x"}'), ("a.json", '{"id": "y"}')]
    assert {r.file for r in problems.collect()} == {"b.json", "c.json", "old.md"}


def test_connectors(spark, tmp_path):
    pages = {None: (["a", "b"], "1"), "1": (["b", "c"], "2"), "2": (["d"], None)}
    fetch = lambda cursor: {"data": [{"traceId": i} for i in pages[cursor][0]], "meta": {"cursor": pages[cursor][1]}}
    assert artifacts.discover(fetch, 10) == ["a", "b", "c", "d"] and artifacts.discover(fetch, 3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        artifacts.discover(lambda c: {"data": [], "meta": {"cursor": "same"}}, 5)

    def gone():
        raise FileNotFoundError

    assert artifacts.fetched(gone, lambda: [1]) == [1] and artifacts.fetched(lambda: [2], gone) == [2]
    with pytest.raises(FileNotFoundError):
        artifacts.fetched(gone, lambda: [1], "legacy")
    m = artifacts.import_records(spark, "json", {"traces": [{"id": "t", "spans": [{"id": "s", "name": "n"}]}]}, str(tmp_path / "o"))
    assert m["trace_count"] == 1
    with pytest.raises(ValueError):
        artifacts.import_records(spark, "json", {"traces": []}, str(tmp_path / "p"), max_bytes=3)
