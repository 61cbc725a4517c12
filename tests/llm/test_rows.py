"""Exact dedup, line dedup and quality rules."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialscope.llm import exact, lines, quality


def test_exact_groups_of_messy_rows(messy, none):
    rows = exact.exact_groups(messy).collect()
    assert len(rows) == 11
    group = [r for r in rows if r.group_size == 4]
    assert len(group) == 4 and {r.keep_id for r in group} == {2} and sum(r.kept for r in group) == 1
    empty = [r for r in rows if r.text_sha256.startswith("e3b0c442")]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {6} and sum(r.kept for r in empty) == 1
    assert exact.exact_groups(none).count() == 0
    out = exact.exact_dedup(messy)
    assert out.columns == messy.columns and sorted(r.doc_id for r in out.collect()) == [2, 6, 7, 8, 9, 10]


def test_heavy_hitters_take_the_other_way(spark):
    rng = random.Random(1)
    texts = ["hot"] * 4000 + ["warm"] * 900 + [f"t{rng.randrange(3000)}" for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = {}
    for i, t in enumerate(texts):
        n, best = want.get(t, (0, -1))
        want[t] = (n + 1, max(best, i))
    for r in exact.exact_groups(df, share=0.05).collect():
        assert (r.group_size, r.keep_id, r.kept) == (*want[texts[r.doc_id]], r.doc_id == want[texts[r.doc_id]][1])
    assert {r.digest for r in exact.heavy_candidates(df.select(F.col("text").alias("digest")), 0.05).collect()} >= {"hot", "warm"}


def test_line_dedup(spark, messy, none):
    rows = [(i, f" common \nown {i}\n\nrare {i // 3}", f"site{i % 7}") for i in range(40)] + [(99, None, "site1"), (100, "common\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.line_dedup(df, counts=("n_lines", "n_removed")).collect()}
    assert got[4] == ("own 4\n\nrare 1", 4, 1) and got[99] == (None, 0, 0) and got[100] == ("", 2, 1)
    assert lines.line_dedup(messy).count() == messy.count() and lines.line_dedup(none).count() == 0


@pytest.mark.parametrize("sites", [4, 5, 6])
def test_line_threshold_is_exact(spark, sites):
    rows = [(k * 100 + s, f"line {k}", f"site{s}") for k in range(1, 12) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.doc_id // 100 for r in lines.line_dedup(df, sites=sites, counts=("n_lines", "n_removed")).filter("n_removed > 0").collect()}
    assert gone == set(range(sites, 12))


def test_counts():
    text = "a b c d e f g h a b c d e f g h\nx#$\n\nx#$ é"
    n, chars, symbols, lines_, repeated = quality.counts(text)
    assert (n, symbols, lines_, repeated) == (19, 4, 0, 16) and chars == 16 + 3 + 3 + 1
    assert quality.counts("") == (0, 0, 0, 0, 0)
    assert quality.counts("q\nq\n \nq")[3] == 2
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        assert quality.counts(" ".join(words))[4] == len(hit)


def test_counts_of_many_texts_are_those_of_each():
    rng = random.Random(7)
    texts = [None, "", " \n\t\x0b ", "a " * 9, "x"] + ["".join(rng.choice(["a", "b ", " ", "\n", "a b c d e f g h ", "\u00a0", "é#", "\t", "\x1c"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    together = quality.counts_of(pa.array(texts))
    assert [tuple(int(c[i]) for c in together) for i in range(len(texts))] == [quality.counts(t or "") for t in texts]
    for text in texts:
        raw = (text or "").encode()
        words, lines_ = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        assert quality.counts(text or "")[:4] == (len(words), sum(len(w.decode()) for w in words), sum(map((text or "").count, "#*$%&|<>")), len(lines_) - len(set(lines_)))


def test_a_very_long_text_takes_little_memory():
    text = "one two three four five six seven eight nine ten " * 200_000
    tracemalloc.start()
    assert quality.counts(text)[4] == 2_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(text)


def test_hosts(spark, messy, none):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, bad if i % 10 else good, "worst") for i in range(200)] + [(1000 + i, good if i % 10 else bad, f"h{i % 5}") for i in range(400)] + [(5000, good, None), (5001, None, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert not got[0].base_failed and not got[0].kept and got[1001].kept and got[5000].kept and not got[5001].kept
    assert sorted(r.doc_id for r in quality.quality_filter(df).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.quality(messy).count() == 11 and quality.quality(none).count() == 0 and quality.quality_filter(none).count() == 0
