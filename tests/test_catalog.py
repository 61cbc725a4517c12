"""Every query with SQL equals DuckDB on the smallest tables; outcomes don't hang on partitioning."""

import datetime as dt
import hashlib
import json
import os
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from trialscope.operators import contracts, detectors, queues, scoring, traces
from trialscope.plans import catalog

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no shared tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_partitioning_changes_nothing(spark):
    t = catalog.trials(spark, TABLES)
    one, many = (sorted(map(str, scoring.verdicts(t.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_json_containment(spark):
    rows = [('{"a": {"b": 1, "c": true}, "l": [1, 2]}',), ('{"a": {"b": true}}',), ('{"a": {"b": 1.0}}',), ('{"a": null}',), (None,)]
    df = spark.createDataFrame(rows, "j string").withColumn("v", F.try_parse_json("j"))
    hit = lambda w: [r[0] for r in df.select(F.coalesce(traces.contains_json(F.col("v"), w), F.lit(False))).collect()]
    assert hit({"a": {"b": 1}}) == [True, False, False, False, False]
    assert hit({"a": {"b": True}}) == [False, True, False, False, False]
    assert hit({"a": {"b": 1.0}}) == [False, False, True, False, False]
    assert hit({"a": None}) == [False, False, False, True, False]
    assert hit({"l": [1, 2]}) == [True, False, False, False, False]
    assert hit({}) == [True, True, True, True, False]
    assert hit({"l": [1]}) == hit({"l": [1, 2.0]}) == hit({"l": [2, 1]}) == [False] * 5
    with pytest.raises(TypeError):
        hit({"l": [object()]})


def test_message_contract(spark):
    call = lambda i: [{"id": i}]
    rows = [("ok", 0, "user", "hi", None, None), ("ok", 1, "assistant", None, call("x"), None), ("ok", 2, "tool", "r", None, "x"), ("ok", 3, "assistant", "done", None, None)]
    rows += [("bad", 0, "robot", "hi", None, None), ("bad", 1, "assistant", None, call("y"), None), ("bad", 2, "user", "too soon", None, None), ("bad", 3, "tool", "r", None, "z")]
    df = spark.createDataFrame(rows, "case_id string, turn int, role string, content string, tool_calls array<struct<id:string>>, tool_call_id string")
    got = {(r.rule, r.key) for r in contracts.messages(df).collect()}
    assert got == {("unknown role", "bad/0"), ("tool call not answered", "bad/1"), ("unknown tool call id", "bad/3")}


def test_message_contract_matches_ids_to_the_end(spark):
    schema = "case_id string, turn int, role string, content string, tool_calls array<struct<id:string>>, tool_call_id string"
    ask = lambda case, turn, *ids: (case, turn, "assistant", None, [{"id": i} for i in ids], None)
    answer = lambda case, turn, i: (case, turn, "tool", "r", None, i)
    rows = [ask("twice", 0, "x", "y"), answer("twice", 1, "x"), answer("twice", 2, "x")]
    rows += [ask("open", 0, "x")]
    rows += [ask("nameless", 0, "x"), answer("nameless", 1, None)]
    rows += [ask("reuse", 0, "x"), answer("reuse", 1, "x"), ask("reuse", 2, "x"), answer("reuse", 3, "x")]
    rows += [ask("same", 0, "x", "x"), answer("same", 1, "x")]
    got = {(r.rule, r.key) for r in contracts.messages(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("tool call answered again", "twice/2"),
        ("tool call not answered", "twice/0"),
        ("tool call not answered", "open/0"),
        ("answer without id", "nameless/1"),
        ("tool call not answered", "nameless/0"),
        ("repeated tool call id", "same/0"),
    }


def test_fingerprint_folds(spark):
    df = spark.createDataFrame([("Straße  ﬁne x",), (" strasse fine X ",)], "t string")
    assert df.select(queues.fingerprint(F.col("t"))).distinct().count() == 1


def test_documents_that_sql_cannot_fold(spark, tmp_path):
    texts = ["plain words", "Straße ﬁne\u00a0 x", "it's 2-fold — «ÉTÉ» 42", "", " \n", None, "a\\b\t\"q\"/"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in catalog.queries()["document_fingerprints"](spark, str(tmp_path)).collect()}
    folded = lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    want = {i: "sha256:" + hashlib.sha256(json.dumps([folded(t)], ensure_ascii=False).encode()).hexdigest() for i, t in enumerate(texts)}
    assert got == want


def test_cards_of_all_lengths_and_separators(spark, tmp_path):
    texts = ["3782 822463 10005, 378282246310005", "4222222222222 and 6304000000000000000", "4111-1111-1111-1111", "41111111111111111234", "4111 1111 1111 1112", "4444444444444444", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_valid for r in catalog.queries()["document_cards"](spark, str(tmp_path)).collect()}
    want = {i: sum(detectors.card(m[0]) for m in detectors.CARD.finditer(t or "")) for i, t in enumerate(texts)}
    assert got == {i: n for i, n in want.items() if n} and got[0] == 2 and got[1] == 2 and got[2] == 1


def test_ideas_keep_their_whole_text(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 200, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert catalog._ideas(spark, str(tmp_path)).first().failure_pattern == "x" * 200


def test_conflicting_runs_fail(spark):
    df = spark.createDataFrame([("r", 1), ("r", 1)], "run_id string, x int")
    assert traces.register_runs(df).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        traces.register_runs(spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, x int")).collect()


def test_latency_over_ranges(spark):
    import random
    import statistics

    rng = random.Random(4)
    for n, ranges in ((1, 4), (2, 4), (399, 8), (1000, 4096)):
        xs = [rng.choice([rng.random() * 1000, 5.0, 5.0, 7.25]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in [*xs, None]], "duration_ms double")
        r = scoring.latency(df, ranges).first()
        assert abs(r.latency_p50_ms - statistics.median(xs)) < 1e-9 and r.latency_p95_ms == sorted(xs)[round(0.95 * (n - 1))] and abs(r.latency_mean_ms - sum(xs) / n) < 1e-6


def test_payload_rules(spark):
    from trialscope.operators import payloads

    assert payloads.strict_object({"a": [1, {"b": None}]}) == {"a": [1, {"b": None}]}
    for bad in ([], {"a": float("nan")}, {1: 2}, {"a": {2: 1}}):
        with pytest.raises(TypeError):
            payloads.strict_object(bad)
    texts = ["{\"a\": \"NaN\"}", "NaN", "[NaN]", "plain", "1", None]
    df = spark.createDataFrame([(json.dumps(t),) for t in texts], "j string").select(F.to_json(payloads.decoded_once(F.parse_json("j"))).alias("o"))
    assert [r.o for r in df.collect()] == ['{"a":"NaN"}', '"NaN"', '"[NaN]"', '"plain"', "1", "null"]
