"""The Merkle manifest against trees built plainly."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trialscope.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each leaf its siblings from below, None where there is none."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            way.append((level[i ^ 1], i & 1) if i ^ 1 < len(level) else None)
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], ways


def plain(rows):
    """doc_id, leaf, subroot, root, proof and whether tampering shows, for rows (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([x[2] for x in sorted(by_lang[k], key=lambda x: x[:3])]) for k in langs]
    root, tops = climb([t[0] for t in trees])
    out = []
    for k, (subroot, ways), top in zip(langs, trees, tops, strict=True):
        for (_, _, own, r), way in zip(sorted(by_lang[k], key=lambda x: x[:3]), ways, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if changed else own
            for s in way + top:
                node = digest(node if s is None else s[0] + node if s[1] else node + s[0])
            out.append((r[0], own, subroot, root, digest("".join(s[0] for s in way + top if s)), node, not changed))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("count", [1, 2, 3, 5, 33])
def test_every_shape_of_one_tree(spark, count, monkeypatch):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], 2))
    rows = [(i, "s", "en", i, f"text {i}") for i in range(count)]
    assert got(merkle.verified(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_many_languages_and_odd_rows(spark, bits, monkeypatch):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], bits))
    rng = random.Random(bits)
    langs = [None, "", "é", "de", "en", "en", "en", "zz", "\U0001f389"]
    rows = [(i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 0, 7, -3]), rng.choice([None, "", "ü" * i, "a:b-"])) for i in range(90)]
    rows += [(3, "a", "en", 1, "same")] * 4 + [(None, None, None, None, None), (None, "x", "en", 2, "no id")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(merkle.verified(df)) == plain(rows)
    assert df.count() == merkle.verified(df).filter("verified or crc32(cast(doc_id as string)) % 7 = 0").count()


def test_a_hot_row_spreads_over_tasks(spark):
    rows = [(1, "a", "en", 1, "same")] * 3000 + [(i, "a", "en", 1, "x") for i in range(2, 500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert got(merkle.verified(df)) == plain(rows)


def test_messy_and_empty_tables(messy, none):
    docs = messy.select("*", F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("x").alias("tree"), F.lit("x").alias("rank"), F.lit("x").alias("n"))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert got(merkle.verified(docs)) == plain(rows)
    assert merkle.verified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8, 9, 31, 64, 100, 129])
def test_the_schedule_keeps_to_its_memory_and_is_never_late(count, monkeypatch):
    nodes = [digest(str(i)).encode() for i in range(count)]
    height, held = merkle.height_of(count), []
    late, finish = [], merkle.Treehash.finish

    def watched(self):
        late.append(not self.absent and not self.done)
        return finish(self)

    paths = merkle.traverse(nodes.__getitem__, count, height, held)
    first = next(paths, None)
    monkeypatch.setattr(merkle.Treehash, "finish", watched)
    root, ways = climb([n.decode() for n in nodes])
    assert [None if s is None else s.decode() for s in first] == [s and s[0] for s in ways[0]]
    for path, way in zip(paths, ways[1:], strict=True):
        assert [None if s is None else s.decode() for s in path] == [s and s[0] for s in way]
    assert not any(late) and max(held, default=0) <= 3 * max(height, 1)
    assert merkle.root_of(nodes.__getitem__, count, height).decode() == root
