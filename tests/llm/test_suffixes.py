import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trialscope.llm import suffixes


def brute(rows):
    seen, out = Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    parts = [some(n) for n in (150, 197, 199, 200, 201, 260, 700)]
    rows = [(i, "".join(some(rng.randrange(150)) + rng.choice(parts)[rng.randrange(3) :] for _ in range(rng.randrange(1, 4)))) for i in range(90)]
    whole = some(3000)
    return rows + [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, some(37) * 20), (105, "a" * 199), (106, "\0" * 250 + some(300) + "\0" * 230), (107, whole), (108, whole[:1500] + "Z" + whole[1500:]), (109, whole[100:2000]), (110, some(130) * 3), (107, whole)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = corpus()
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(brute(rows))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 128)
    texts = [t for _, t in corpus() if t]
    for data, sizes, first, start in suffixes._blocks([t.encode() for t in texts]):
        a = suffixes.anchors(data, sizes)
        assert (a["at"] >= a["left"]).all() and first < len(texts) and start >= 0
    rows = corpus()
    found = sorted(brute(rows))
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == found


def test_piece_borders_change_no_segment(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [some(n) for n in (4096, 4097, 5000, 9000, 1023)] + ["a" * 3000]
    texts.append(some(505) + texts[3][4000:4700] + some(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row", "text"])

    def segments():
        dealt = pa.Table.from_batches(suffixes._deal(1)([batch]))
        return sorted(zip(*(np.concatenate([suffixes.unplanes(x, suffixes._COLUMNS[c]) for x in dealt.column(c).to_pylist()]).tolist() for c in ("row", "at", "left", "more", "gram", "segment")), strict=True))

    whole = segments()
    monkeypatch.setattr(suffixes, "BLOCK", 128)
    assert segments() == whole and len({s[:2] for s in whole}) == len(whole)
    rows = list(enumerate(texts))
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == sorted(brute(rows))


@pytest.mark.parametrize("block", [4, 7, 1 << 20])
def test_columns_inserted_one_by_one(block, tmp_path):
    rng = np.random.default_rng(0)
    n = 60
    body = rng.integers(97, 99, (n, suffixes._SIZE)).astype(np.uint8)
    for i in range(0, n, 3):
        body[i + 1] = body[i]
        body[i + 1, : rng.integers(0, 60)] = 120
        body[i + 2] = body[i]
        body[i + 2, 250 + rng.integers(0, 50) :] = 121
    low, high = np.zeros(n, np.int16), np.full(n, suffixes._SIZE, np.int16)
    high[5], low[9] = 240, 30
    group = np.sort(np.append(np.arange(n - 20) // 6, np.full(20, 3)))
    made = suffixes.Construction(str(tmp_path), n, block)
    made.columns[:] = body.T
    made.run(group, low, high)
    got = np.array(made.hits).T
    for i in range(n):
        for c in range(suffixes.REACH + 1):
            fits = lambda k: low[k] <= c and c + 200 <= high[k]  # noqa: E731, B023
            want = fits(i) and any(k != i and group[k] == group[i] and fits(k) and (body[k, c : c + 200] == body[i, c : c + 200]).all() for k in range(n))
            assert got[i, c] == want


def test_dealt_twice(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(suffixes, "FAN", 4)
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(brute(rows))


@pytest.mark.parametrize("most", [3, 100])
def test_anchors_with_many_contexts(spark, monkeypatch, most):
    rows = corpus()
    monkeypatch.setattr(suffixes, "MOST", most)
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(brute(rows))


def test_a_passage_in_very_many_texts(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(450)
    rows = [(i, some(rng.randrange(40)) + passage + some(rng.randrange(40))) for i in range(700)]
    assert rows_of(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == sorted(brute(rows))


def test_messy_rows(messy, none):
    out = suffixes.suffix_dedup(messy).collect()
    assert len(out) == 11 and suffixes.suffix_dedup(none).count() == 0
    assert {r.doc_id: r.n_removed for r in out if r.doc_id in (5, 6, 7, 10)} == {5: 0, 6: 0, 7: 0, 10: 0}
    long = next(r for r in out if r.doc_id == 8)
    assert long.n_removed == long.n_bytes
