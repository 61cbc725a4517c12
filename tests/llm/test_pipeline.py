import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_jaccard import brute
from test_pii_toxicity import Plain
from tokenizers import Tokenizer

import corpus_pipeline
from trialscope.llm import pii, registry
from trialscope.llm.common import written


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    words = lambda k: " ".join(f"w{(i * 7919 + k * 104729) % 100003}" for i in range(60))
    rows = [(k, words(k), "en", f"src{k % 3}", 0) for k in range(40)]
    rows += [(100, words(1), "en", "src1", 0), (101, words(2) + " extra", "en", "src1", 0), (102, "short", "en", "src2", 0), (103, words(3) + " 4111111111111111", "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append({r.doc_id for r in docs.collect()})
    everyone = {r[0] for r in rows}
    assert seen[0] == everyone - {102} and seen[1] == seen[0] - {1} and seen[2] == seen[1] - {101, 103} and seen[3] == seen[2]
    assert "4111111111111111" not in "".join(r.text for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]


def test_registry_has_one_query_per_operator():
    names = list(registry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def brute_quality(rows):
    """Rows that stay, from the definitions: base rules, then hosts by the shrunk rate of their failures."""
    failed = {}
    for doc, text, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
        failed[doc] = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    hosts = defaultdict(list)
    for doc, _, source in rows:
        if source is not None:
            hosts[source].append(failed[doc])
    total = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / total
    squares = sum(sum(f) ** 2 / len(f) for f in hosts.values()) / total
    within = mean * (1 - mean)
    between = max(squares - mean * mean - within * len(hosts) / total, 1e-9)
    weight = min(max(within / between - 1, 1.0), 10_000.0)
    a, b = mean * weight, (1 - mean) * weight
    bad = set()
    for host, f in hosts.items():
        rate = (sum(f) + a) / (len(f) + a + b)
        if rate - 2 * math.sqrt(rate * (1 - rate) / (len(f) + a + b + 1)) > 0.6:
            bad.add(host)
    return {doc for doc, _, source in rows if not failed[doc] and source not in bad}


def random_corpus():
    rng = random.Random(17)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, texts = [], []
    for i in range(160):
        kind = rng.randrange(8)
        if kind == 0 and texts:
            text = rng.choice(texts)
        elif kind == 1 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(some(rng.randrange(15)))
        elif kind == 3:
            text = " ".join(some(9) * 6)
        else:
            text = " ".join(some(rng.randrange(20, 90)))
            texts.append(text)
        if rng.randrange(5) == 0:
            text += " mail ann@example.com or 4111 1111 1111 1111"
        rows.append((i, text, "bad" if kind in (2, 3) and rng.random() < 0.7 else f"h{rng.randrange(6)}" if i % 13 else None))
    rows += [(900 + i, "too short", "bad") for i in range(30)] + [(990, " ".join(some(40)), "bad"), (991, None, "h1"), (992, "", None)]
    return rows


def test_every_stage_against_brute_force(spark):
    rows = random_corpus()
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: written(stages[name](spark, df, ""), "tested")
    got = lambda df: {r.doc_id: r.text for r in df.collect()}

    one = run("quality rules", docs)
    kept = brute_quality(rows)
    assert set(got(one)) == kept and 990 not in kept and 20 < len(kept) < 160

    two = run("exact dedup", one)
    best = {}
    for d, t in got(one).items():
        best[t] = max(d, best.get(t, -1))
    assert set(got(two)) == set(best.values()) and len(best) < len(kept)

    three = run("n-gram Jaccard join", two)
    components = {d: c for d, (_, c) in brute(list(got(two).items())).items()}
    assert set(got(three)) == set(components.values()) and len(set(components.values())) < len(components)

    four = got(run("private values", three))
    plain = Plain(pii.key_of(spark))
    replaced = {d: t.replace("ann@example.com", plain.email("ann@example.com")).replace("4111 1111 1111 1111", plain.card("4111 1111 1111 1111")) for d, t in got(three).items()}
    assert four == replaced and four != got(three)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    frame = spark.createDataFrame(list(four.items()), "doc_id long, text string")
    pieces, windows = defaultdict(list), Counter()
    for r in stages["packing"](spark, frame, "").collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id] += r.length
    assert set(pieces) == set(four) and max(windows.values()) <= 2048
    for d, parts in pieces.items():
        ids, at = np.array([*library.encode(four[d], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
