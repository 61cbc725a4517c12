"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens by the tokenizer's pattern on the JVM. Each batch of documents becomes a chunk: its
distinct words, and for each document the words' codes by position. Only the distinct words of a chunk are dealt out,
by hash; each word of the corpus is so encoded once, its ids go back to the chunks that hold it, and the documents are
put together again by position. Decoding joins ids with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import bucketed, fields, frugal, frugal_group, give_back, packed_words, planes, text_of, unplanes, words_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Unicode's White_Space, which Java's \s leaves out in part.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A rank file with more tokens is refused: it is broadcast.
MOST_TOKENS = 1_000_000
#: Codes that are spread at once, to bound memory.
BLOCK = 1 << 18
#: Bytes of text whose words a task encodes, about: a part gets an equal share of all words.
PART_BYTES = 64 << 20
#: Pre-tokens of a chunk, about: enough that its words repeat, few enough for a worker's memory.
CHUNK = 1_500_000


def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The split pattern for Java's regular expressions, with Unicode's white space."""
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern()), F.lit(0))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{len(ranks)} tokens; at most {MOST_TOKENS} are broadcast")
    return ranks


#: Stands between words that are encoded together: a space within other characters, which no match of the pattern has.
BETWEEN = "\ue000 \ue000"
#: Words that are encoded together.
TOGETHER = 100_000

_ENCODER: dict[str, tiktoken.Encoding] = {}


def named(ranks: dict[bytes, int]) -> tuple[str, dict[bytes, int]]:
    """Ranks and their digest, by which workers know them."""
    return hashlib.sha256(b"".join(b"%d %d " % (i, len(t)) + t for t, i in ranks.items())).hexdigest(), ranks


def _encoding(digest: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """The encoding of these ranks; a Python worker keeps the last one."""
    if digest not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[digest] = tiktoken.Encoding(f"ranks-{digest}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={BETWEEN: max(ranks.values()) + 1})
    return _ENCODER[digest]


def word_encoder(digest: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """From one pre-token its ids, with little memory."""
    return _encoding(digest, ranks).encode_ordinary


def encoder(digest: str, ranks: dict[bytes, int]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """From pre-tokens their ids, one after the other, and the number of each one's."""
    encoding, end = _encoding(digest, ranks), max(ranks.values()) + 1

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            got = encoding.encode_to_numpy(BETWEEN.join(some), allowed_special={BETWEEN})
            cuts = np.flatnonzero(got == end)
            if len(cuts) != len(some) - 1:
                raise ValueError("a word holds the mark between words, so it is no match of the pattern")
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
            ids.append(got[got != end].astype(np.uint32))
        return np.concatenate(ids), np.concatenate(lengths)

    return encode


def word_codes(tokens: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a batch, most frequent first; each pre-token's code; the pre-tokens of each document."""
    sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()  # flatten keeps to a slice's own values
    codes, words = flat.indices.to_numpy(), flat.dictionary
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return words.take(pa.array(order)).to_pylist(), rank[codes] if len(codes) else np.empty(0, np.uint32), sizes


def spread(codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code in turn (a code's are at its start, so many as its length), and the end of each document's."""
    n = lengths[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n, dtype=np.int64)])
    out = np.empty(ends[-1], values.dtype)
    for a in range(0, len(codes), BLOCK):
        b = min(a + BLOCK, len(codes))
        at = np.arange(ends[b] - ends[a]) + np.repeat(starts[codes[a:b]] - (ends[a:b] - ends[a]), n[a:b])
        out[ends[a] : ends[b]] = values[at]
    return out, ends[np.cumsum(sizes)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where they would pass CHUNK pre-tokens."""
    for batch in batches:
        run = np.cumsum(np.diff(batch.column("tokens").offsets.to_numpy()), dtype=np.int64) // CHUNK
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _chunks(parts: int) -> Callable:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(_pieces(batches)):
            words, codes, sizes = word_codes(batch.column("tokens"))
            part = (pd.util.hash_array(np.array(words, object), categorize=False) % parts).astype(np.uint32) if words else np.empty(0, np.uint32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            used = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            dealt = pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.array([packed_words([words[i] for i in order[cuts[p] : cuts[p + 1]]]) for p in used], pa.binary())], ["part", "words"])
            columns = {
                "chunk": pa.array([(TaskContext.get().partitionId() << 24) + k], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
                "sizes": pa.array([planes(sizes)], pa.binary()),
                "codes": pa.array([planes(codes)], pa.binary()),
                "parts": pa.array([planes(part)], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), dealt),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _encode_words(ranks) -> Callable[[pa.Table], pa.Table]:
    @frugal_group
    def run(table: pa.Table) -> pa.Table:
        number: dict[str, int] = {}  # each distinct word once
        codes = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(blob.as_py())), np.int64) for blob in table.column("words")]
        ids, lengths = encoder(*ranks.value)(list(number))
        del number
        starts = np.cumsum(lengths) - lengths
        out_ids, out_lengths = [], []
        for of in codes:
            out_lengths.append(planes(lengths[of].astype(np.uint32)))
            out_ids.append(planes(spread(of, np.array([len(of)]), starts, lengths, ids)[0]))
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "ids": pa.array(out_ids, pa.binary()), "lengths": pa.array(out_lengths, pa.binary())})

    return run


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one chunk with their ids."""
    right = right.sort_by("part")
    lengths = np.concatenate([np.empty(0, np.uint32), *(unplanes(x, np.uint32) for x in right.column("lengths").to_pylist())])
    values = np.concatenate([np.empty(0, np.uint32), *(unplanes(x, np.uint32) for x in right.column("ids").to_pylist())])
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    order = np.argsort(unplanes(left.column("parts")[0].as_py(), np.uint32), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, sizes = unplanes(left.column("codes")[0].as_py(), np.uint32), unplanes(left.column("sizes")[0].as_py(), np.int64)
    ids, ends = spread(place[codes] if len(codes) else codes.astype(np.int64), sizes, starts, lengths, values)
    doc_ids = left.column("doc_ids").combine_chunks()
    doc_ids = (doc_ids.chunk(0) if isinstance(doc_ids, pa.ChunkedArray) else doc_ids).flatten()
    give_back()
    return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))})


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """One row per row of docs: doc_id, ids. A null text counts as empty and has no ids; repeated rows are encoded
    each; an empty table gives no rows. Special tokens' strings are ordinary text."""
    spark = docs.sparkSession
    size = fields(docs, text=text_col).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    ranks = spark.sparkContext.broadcast(named(read_ranks(ranks_path)))
    own = fields(docs, doc_id=id_col, text=text_col).select("doc_id", pretokens(text_of()).alias("tokens"))
    kind = own.schema["doc_id"].dataType.simpleString()
    chunks = bucketed(own.mapInArrow(_chunks(parts), f"chunk long, doc_ids array<{kind}>, sizes binary, codes binary, parts binary, words array<struct<part: int, words: binary>>"), "chunks", "chunk")
    words = chunks.select("chunk", F.explode("words").alias("w")).select("chunk", "w.part", "w.words")
    ids = words.groupBy("part").applyInArrow(_encode_words(ranks), "chunk long, part int, ids binary, lengths binary")
    left = chunks.select("chunk", "doc_ids", "sizes", "codes", "parts")
    return left.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_reassemble, f"doc_id {kind}, ids array<int>")


def _decode_batches(table) -> Callable:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = sorted(table.value.items(), key=lambda x: x[1])
        lengths = np.zeros(by_id[-1][1] + 1, np.int64)
        for token, i in by_id:
            lengths[i] = len(token)
        values = np.frombuffer(b"".join(token for token, _ in by_id), np.uint8)
        starts = np.cumsum(lengths) - lengths
        for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy()
            data, ends = spread(flat, np.diff(ids.offsets.to_numpy()).astype(np.int64), starts, lengths, values)
            raw = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, raw], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, ids and the bytes they stand for. An id that the table doesn't have fails the job."""
    table = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(table), f"doc_id {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    d = decode(encode(docs))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(text, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
