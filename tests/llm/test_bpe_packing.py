import base64
import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from trialscope.llm import bpe, packing

TEXTS = ["It's 'll  a\n\n\tb   c\x1c\x1dd", "<|endoftext|> 中文字 é ½ ٣٤ 🎉🎉\r\n   ", "", None, "word " * 5000, "same words same words", "x" * 3000, " ", "a b c\u0085d", " ", "    x  \n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, None, 0), (5, TEXTS[5], 0), (None, "no id", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)


def test_encode_and_decode_as_the_library_does(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=key) == sorted(want, key=key)


def test_small_chunks_give_the_same_ids(docs, monkeypatch):
    whole = sorted(map(str, bpe.encode(docs).collect()))
    monkeypatch.setattr(bpe, "CHUNK", 3)
    assert sorted(map(str, bpe.encode(docs).collect())) == whole


def test_empty_tables(docs):
    assert bpe.round_trip(docs.limit(0)).count() == 0 and packing.pack(docs.limit(0)).count() == 0


def packed(docs, **options):
    """The pieces by document, whose windows were found whole."""
    windows, by_doc = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, **options).collect():
        windows[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return by_doc


def same_ids(pieces, ids):
    """Whether pieces are those of one document with these ids."""
    ids, at = np.array([*ids, 1], "<u4"), 0
    for r in sorted(pieces, key=lambda r: r.start):
        assert (r.start, r.doc_tokens) == (at, len(ids))
        at += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
    assert at == len(ids)


SPECIAL = ["<|endoftext|>", "x <|endoftext|> y", " <|endoftext|>", "a  <|endoftext|>\n\n<|endoftext|><|endoftext|> b's", "<|endoftext", "<|endoftext|", "<<|endoftext|>>", "it<|endoftext|>'s  ", "<|ENDOFTEXT|> <|endoftext |>"]


@pytest.mark.parametrize("added", [True, False])
def test_packing(spark, added):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = not added  # its default, and the other way
    texts = [*TEXTS, *SPECIAL]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    by_doc = packed(df, added=added)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        same_ids(pieces, library.encode(texts[doc] or "", add_special_tokens=False).ids)


def test_packing_of_repeated_and_nameless_rows(docs, messy):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs, messy):
        tokens, starts = defaultdict(int), defaultdict(int)
        for doc, pieces in packed(df).items():
            tokens[doc], starts[doc] = sum(r.length for r in pieces), sum(r.start == 0 for r in pieces)
        for r in df.collect():
            starts[r.doc_id] -= 1
            tokens[r.doc_id] -= len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert not any(tokens.values()) and not any(starts.values())


def test_added_tokens_of_one_start_and_of_odd_kinds(spark, tmp_path):
    vocabulary = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    plain = vocabulary["added_tokens"][0]
    vocabulary["added_tokens"] += [plain | {"id": 50257, "content": "<|endoftext|>more"}, plain | {"id": 50258, "content": "a+b"}]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(vocabulary), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    texts = ["x <|endoftext|>more y", "a+ba+b a+", "<|endoftext|>mor"]
    for doc, pieces in packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary=str(path)).items():
        same_ids(pieces, library.encode(texts[doc], add_special_tokens=False).ids)
    path.write_text(json.dumps(vocabulary | {"added_tokens": [plain | {"lstrip": True}]}), encoding="utf-8")
    with pytest.raises(ValueError):
        packing.read_added(str(path))


def test_windows_stay_bounded_and_full():
    w, done = packing.Windows(100, 4, 5), []
    rng = np.random.default_rng(1)
    for n in rng.integers(1, 250, 2000):
        w.add(int(n), lambda a, b: b - a, done)
        assert len(w.room) <= 4
    assert all(95 <= sum(x) <= 100 for x in done)


def test_words_encoded_together_are_as_alone(monkeypatch):
    ranks = bpe.read_ranks()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["", " ", "", " ", "  ", "a", " b", "'s", "中文", "\n\n", "x" * 500, "!?"]
    for together in (1, 3, 100):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        ids, lengths = bpe.encoder(*bpe.named(ranks))(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode_ordinary(w) for w in words]
    ids, lengths = bpe.encoder(*bpe.named(ranks))([])
    assert len(ids) == len(lengths) == 0
    with pytest.raises(ValueError):
        bpe.encoder(*bpe.named(ranks))([bpe.BETWEEN, "a"])
