"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialscope.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = lang or ("und" if lang is None else "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, all_ in counts.items():
        found = {p: a for p, a in all_.items() if a >= least}
        longer = {q: max((found[p] for p in found if len(p) > len(q) and any(p[i : i + len(q)] == q for i in range(len(p)))), default=0) for q in found}
        scored = []
        for p, a in found.items():
            if len(p) > 1 and 100 * longer[p] < 100 * a:
                cuts = [(1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(rng, count, words, langs):
    vocabulary = [f"w{i}" for i in range(words)] + ["Of", "THE", "é", "É", "\x00", "a-b"]
    common = "in the year of our lord"
    rows = []
    for i in range(count):
        picked = [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(rng.randrange(40))]
        picked += [common] * (rng.random() < 0.4) + [rng.choice(["x x x x x x", "tic\ttac", "."])]
        rng.shuffle(picked)
        rows.append((i, rng.choice([" ", "  ", ", ", "\n", "\t"]).join(picked), rng.choice(langs)))
    return rows


@pytest.mark.parametrize("split,part,fan,listed", [(250_000, 1_000_000, 4096, 1 << 20), (7, 20, 4096, 0), (7, 20, 3, 1 << 20), (7, 20, 3, 0)])
def test_collocations(spark, monkeypatch, split, part, fan, listed):
    monkeypatch.setattr(phrases, "LIST_BYTES", listed)
    monkeypatch.setattr(phrases, "SPLIT", split)
    monkeypatch.setattr(phrases, "PART", part)
    monkeypatch.setattr(phrases, "FAN", fan)
    rows = texts(random.Random(3), 260, 60, ["en", "de", None]) + [(900, None, "en"), (901, "", None), (902, "alone", "xx"), (903, "tie tie", "und"), (903, "tie tie", "und")]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=6, top=40)
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 40)


def test_every_phrase_is_counted_once(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(30):
        ranks = rng.integers(0, 5, 60).astype(np.uint32)
        want = Counter(tuple(ranks[i : i + m].tolist()) for m in range(2, 6) for i in range(61 - m) if ranks[i : i + m].all())
        rows = phrases.fragments(ranks)
        rows, weights = phrases.merged(rows, np.ones(len(rows), np.int64))
        got = Counter()
        for found, sums in phrases.mined(rows, weights, 1):
            for p, a in zip(map(tuple, found.tolist()), sums.tolist(), strict=True):
                got[p] += a
        assert got == want


def test_keys_hold_whole_rows_of_large_ranks():
    rng = np.random.default_rng(2)
    rows = rng.choice(np.array([1, 2**31, 2**32 - 1, 7], np.uint32), (4000, 9))
    keys = phrases.keys_of(list(rows.T))
    assert len(set(keys.tolist())) == len({tuple(r) for r in rows.tolist()})
    by = {}
    assert all(by.setdefault(k, tuple(r)) == tuple(r) for k, r in zip(keys.tolist(), rows.tolist(), strict=True))


def test_texts_are_cut_between_pieces_only():
    raw = b"a b c\nlong piece without an end " + b"x" * 50 + b"\nd e\nf"
    for most in (1, 5, 20, 1000):
        runs = list(phrases._cut(raw, most))
        assert b"\n".join(runs) == raw
    words, counts, codes = phrases.codes_of(b"b a\nb  c\n")
    assert words[0] == "b" and counts.tolist() == [2, 1, 1] and (codes == 0).sum() == 2 and len(codes) == 6
    assert phrases.codes_of(b"")[0] == []


def test_messy_and_empty_tables(messy):
    docs = messy.select("*", F.col("kept").alias("lang"), F.lit(1).alias("tree"), F.lit("x").alias("ids"), F.lit("x").alias("phrase"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got = phrases.collocations(docs, least=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**9).count() == 0
