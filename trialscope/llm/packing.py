"""Bounded-space online packing into fixed windows of tokens.

Each partition keeps OPEN windows open. A document's whole windows leave at once; its rest goes into the open window
that it fits best. When none fits, the fullest is emitted; if that would leave more than SLACK tokens of padding, it
is first filled with the head of the arriving piece. Windows left over at the end of a partition are merged with those
of MERGE others, by the same rule.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.bpe import named, pretokens, spread, word_codes, word_encoder
from trialscope.llm.common import fields, frugal, frugal_group, slices, text_of, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW, END, OPEN, SLACK, MERGE = 2048, 1, 64, 16, 64
#: Words whose ids a task remembers.
CACHE = 200_000
#: Pre-tokens that a worker takes at once, about.
BLOCK = 500_000

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE in the tokenizers library's format, whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
    wanted = {c: model["vocab"][c] for c in byte_of} | {t: model["vocab"][t] for t in joined}
    return {bytes(byte_of[c] for c in token): i for token, i in wanted.items()}


def read_added(path: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's added tokens and their ids. Those that take the white space around them, or stand for whole words
    alone, are refused: no text is split at such here."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"{token['content']!r} is not a plain added token")
    return {token["content"]: token["id"] for token in found}


def split_at(text: Column, added: Iterable[str]) -> Column:
    """The pre-tokens of a text, in which added tokens stand by themselves; between two of them the text is split as if
    it were one of its own. Of added tokens that start at one place the longest counts."""
    quoted = sorted((re.sub(r"([^A-Za-z0-9])", r"\\\1", t) for t in added), key=len, reverse=True)
    if not quoted:
        return pretokens(text)
    any_ = "|".join(quoted)
    parts = F.zip_with(F.split(text, any_), F.regexp_extract_all(text, F.lit(f"({any_})"), F.lit(1)), lambda own, token: F.concat(pretokens(F.coalesce(own, F.lit(""))), F.when(token.isNotNull(), F.array(token)).otherwise(F.array().cast("array<string>"))))
    return F.when(text.rlike(any_), F.flatten(parts)).otherwise(pretokens(text))


class Windows:
    """The open windows of a partition: (room, key), by room."""

    def __init__(self, size: int, most: int, slack: int):
        self.size, self.most, self.slack = size, most, slack
        self.room: list[tuple[int, int]] = []
        self.inside: dict[int, list] = {}
        self.made = 0

    def add(self, length: int, cut: Callable, done: list) -> None:
        """Place a piece of the given length; cut(a, b) gives what to store for its part from a to b."""
        at = 0
        while at < length:
            if length - at >= self.size:
                done.append([cut(at, at + self.size)])
                at += self.size
                continue
            i = bisect_left(self.room, (length - at, -1))
            if i < len(self.room):
                room, key = self.room.pop(i)
            elif len(self.room) < self.most:
                room, key, self.made = self.size, self.made, self.made + 1
                self.inside[key] = []
            else:
                room, key = self.room.pop(0)
                if 0 < room <= self.slack:
                    done.append(self.inside.pop(key))
                    continue
            n = min(room, length - at)
            self.inside[key].append(cut(at, at + n))
            at += n
            if room - n:
                insort(self.room, (room - n, key))
            else:
                done.append(self.inside.pop(key))


def _ids_of(words: list[str], encode: Callable, seen: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(seen) > CACHE:
        seen.clear()
    ids = []
    for w in words:
        x = seen.get(w)
        if x is None:
            x = seen[w] = encode(w)
        ids.append(x)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.cumsum(lengths) - lengths, lengths, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))


def _pack_batches(ranks, added: dict[str, int], window: int, end: int) -> Callable:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, task, n = word_encoder(*ranks.value), Windows(window, OPEN, SLACK), TaskContext.get().partitionId(), 0
        seen: dict[str, list[int]] = {}
        own = lambda w: [added[w]] if w in added else encode(w)
        for batch in slices(batches, "tokens", BLOCK):
            words, codes, sizes = word_codes(batch.column("tokens"))
            ids, ends = spread(codes, sizes, *_ids_of(words, own, seen))
            done: list[list] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), np.concatenate([[0], ends[:-1]]) if len(ends) else [], ends, strict=True):
                all_ = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                windows.add(len(all_), lambda x, y, all_=all_, doc=doc: (doc, x, y - x, zlib.crc32(all_[x:y].tobytes()), len(all_)), done)
            yield _rows(done, task, n, True)
            n += len(done)
        yield _rows(list(windows.inside.values()), task, n, False)

    return run


def _laid(pieces: list[dict]) -> list[dict]:
    """The pieces of one window, one after the other."""
    at = 0
    for p in pieces:
        p["offset"] = at
        at += p["length"]
    return pieces


def _rows(done: list[list], task: int, first: int, closed: bool) -> pa.RecordBatch:
    pieces = [_laid([dict(zip(_PIECE.names, p, strict=False)) for p in w]) for w in done]
    return pa.RecordBatch.from_arrays([pa.array([(task << 32) + first + i for i in range(len(done))], pa.int64()), pa.array([closed] * len(done), pa.bool_()), pa.array([task // MERGE] * len(done), pa.int64()), pa.array(pieces, pa.list_(_PIECE))], ["sequence_id", "closed", "merge", "pieces"])


def _merge(window: int) -> Callable:
    @frugal_group
    def run(table: pa.Table) -> pa.Table:
        """Leftover windows of up to MERGE partitions, each put whole into another where it fits."""
        table = table.sort_by("sequence_id")
        windows, done = Windows(window, 1 << 30, 0), []
        left = table.column("pieces").to_pylist()
        by_size = sorted(range(len(left)), key=lambda i: -sum(p["length"] for p in left[i]))
        for i in by_size:
            windows.add(sum(p["length"] for p in left[i]), lambda x, y, i=i: i, done)
        groups = [*done, *windows.inside.values()]
        ids = table.column("sequence_id").to_pylist()
        return pa.table({"sequence_id": pa.array([ids[g[0]] for g in groups], pa.int64()), "pieces": pa.array([_laid([p for i in g for p in left[i]]) for g in groups], pa.list_(_PIECE))})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END, added: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then `end`; a null or empty text has only that one. The vocabulary's added tokens
    are recognised in texts, as the library does unless it is told otherwise; with added=False their strings are ordinary
    text. Repeated rows are packed each, null ids stay null, an id that is no whole number becomes null or fails, as the
    session's casts do; an empty table gives no rows and no other column is read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(named(read_vocabulary(vocabulary)))
    tokens = read_added(vocabulary) if added else {}
    own = fields(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), split_at(text_of(), tokens).alias("tokens"))
    piece = "array<struct<doc_id: long, start: long, length: long, ids_crc32: long, doc_tokens: long, offset: long>>"
    made = written(own.mapInArrow(_pack_batches(ranks, tokens, window, end), f"sequence_id long, closed boolean, merge long, pieces {piece}"), "windows")
    merged = made.filter("not closed").groupBy("merge").applyInArrow(_merge(window), f"sequence_id long, pieces {piece}")
    rows = made.filter("closed").select("sequence_id", "pieces").unionByName(merged)
    return rows.select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")
