import random
import re
from collections import defaultdict

import numpy as np
import pytest

from trialscope.llm import components as cc
from trialscope.llm import jaccard


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    at, shared = defaultdict(list), defaultdict(int)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    for ds in at.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] += 1
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)] + ["É", "Zz"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, base, shared = [], some(90), some(30)
    drift = base[:]
    for k in range(60):
        x = base[:]
        for _ in range(rng.randrange(4)):
            x[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(x)
        drift[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(drift[:])
        texts.append(some(rng.randrange(1, 60)) + shared + some(5))
    for n in range(1, 24):
        x = some(n)
        texts += [x, x[1:], x[:-1], x[1:-1]]
    texts += [base] * 40
    rows = [(i, " ".join(t).upper() if i % 5 == 0 else "\n".join(t)) for i, t in enumerate(texts)]
    return [*rows, (9000, None), (9001, ""), (9002, " \t")]


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    signed = lambda z: [jaccard.signatures([np.sort(x)]) for x in z]
    met = 0
    for _ in range(400):
        size = int(rng.integers(1, 160))
        base = np.unique(rng.integers(0, 1 << 62, 2 * size).astype(np.uint64))
        rng.shuffle(base)
        a = base[:size]
        gone = int(rng.integers(0, size // 5 + 1))
        b = np.concatenate([a[gone:], base[size : size + int(rng.integers(0, max(1, size // 9)))]])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = signed((a, b))
            shared = [set(zip(z.sig.tolist(), z.split.tolist(), strict=True)) for z in (x, y)]
            common = shared[0] & shared[1]
            assert common
            # as many parts as the slack says, in some split
            for z in (x, y):
                parts = {}
                for sig, split, spot, slack in zip(z.sig.tolist(), z.split.tolist(), z.spot.tolist(), z.slack.tolist(), strict=True):
                    parts.setdefault(split, (slack, set()))
                    if (sig, split) in common:
                        parts[split][1].add(spot)
                assert any(len(spots) >= (slack + 2) // 2 for slack, spots in parts.values())
            met += 1
    assert met > 150


def test_signatures_do_not_depend_on_other_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 3, 9, 10, 40, 41, 300, 1000, 0, 12)]
    together = jaccard.signatures(sets)
    for i, x in enumerate(sets):
        alone, own = jaccard.signatures([x]), together.owner == i
        key = lambda s, m: sorted(zip(s.sig[m].tolist(), s.spot[m].tolist(), s.split[m].tolist(), s.slack[m].tolist(), strict=True))
        assert key(alone, slice(None)) == key(together, own)


def test_messy_rows(messy, none):
    rows = jaccard.similar_components(messy).collect()
    assert len(rows) == 11
    got = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert got == {1: 1, 2: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    kept = jaccard.near_duplicate_filter(messy)
    assert kept.columns == messy.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 5, 6, 7, 8, 10]
    assert jaccard.similar_components(none).count() == 0 and jaccard.near_duplicate_filter(none).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(cc, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
