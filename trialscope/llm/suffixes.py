"""Removal of repeated substrings of 200 bytes.

A collection-wide column-wise construction needs a round per byte of the longest text, each over the whole collection
(see the README), so it is confined to where repeats can be. Every window of WIDTH bytes has an anchor, the least of
its GRAM-byte grams by hash; equal windows have equal anchors, and the windows of one anchor form a segment. Equal
segments are settled by their digest. Where an anchor has unlike segments, one context of each is sent to the anchor's
task, which runs the column-wise construction over its contexts: one byte of each is inserted a round, from the right,
updating the transform, the contexts' order and their longest common prefixes in sequential files. A window whose prefix
with a neighbour reaches WIDTH repeats. The windows of an anchor with more than MOST contexts, at the border of a
passage that a great many texts share, meet by digests instead, in a counting shuffle.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, frugal, frugal_group, planes, slices, small, text_of, unplanes, written
from trialscope.llm.jaccard import mixed

WIDTH, GRAM = 200, 100
REACH = WIDTH - GRAM  # a window starts at most so far left of its anchor
#: Bytes of text that a worker takes at once, and bytes whose segments a task settles, about.
SLICE, PART_BYTES = 16 << 20, 64 << 20
#: Parts that a slice is dealt to at once; beyond them segments are dealt twice, first to coarse parts.
FAN = 2048
#: An anchor with more contexts isn't compared in one task: its windows meet by their digests.
MOST = 50_000
#: Contexts that a block of the construction's files has.
ENTRIES = 1 << 20
#: Bytes of text hashed at once, and the entries of a side that may be broadcast (about 24 bytes each).
BLOCK, BROADCAST_ENTRIES = 1 << 20, 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_PLACE = np.uint64((1 << 24) - 1)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)  # a second base, where a digest is of 128 bits
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get(int(base), ((),))[0]) < n:
        m, back = max(2 * n, 2 * BLOCK), np.uint64(pow(int(base), -1, 1 << 64))
        _POWERS[int(base)] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b)])) for b in (base, back))
    up, back = _POWERS[int(base)]
    return up[:n], back[:n]


class Hashes:
    """Rolling hashes of a buffer."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASE):
        up, self.back = _powers(len(data) + 1, base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def anchors(data: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The segments of texts laid one after the other: text number, anchor place in the text, bytes that the segment's
    first window starts before it, its windows less one, and the hashes of anchor and segment."""
    ends = np.cumsum(sizes)
    last = len(data) - WIDTH
    if last < 0:
        return {k: np.empty(0, t) for k, t in (("text", np.int64), ("at", np.uint32), ("left", np.uint8), ("more", np.uint8), ("gram", np.uint64), ("segment", np.uint64))}
    h = Hashes(data)
    grams = mixed(h.grams(GRAM))
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = REACH + 1
    padded = np.concatenate([keys, np.full(-len(keys) % span, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, span)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: last + 1], before[REACH : REACH + last + 1])
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(text[: last + 1] == text[WIDTH - 1 : WIDTH + last])
    place = (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)])) if len(inside) else np.empty(0, np.int64)
    final = np.append(first[1:], len(inside)) - 1 if len(first) else first
    x0, x1, at = inside[first], inside[final], place[first]
    segment = mixed(h.of(x0, x1 + WIDTH) + mixed(((at - x0) * 256 + (x1 - x0)).astype(np.uint64)))
    owner = text[x0]
    return {"text": owner, "at": (at - (ends - sizes)[owner]).astype(np.uint32), "left": (at - x0).astype(np.uint8), "more": (x1 - x0).astype(np.uint8), "gram": grams[at], "segment": segment}


def _blocks(texts: list[bytes], block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Runs of texts of about `block` bytes: data, sizes, number of the first text, and where its piece starts. A text
    of more than 8 blocks comes in pieces of 4 blocks of windows and one before; REACH + 1 more follow, so a piece has
    the whole of each segment that starts in its blocks (see _own)."""
    block = block or BLOCK
    i = 0
    while i < len(texts):
        if len(texts[i]) > 8 * block:
            for own in range(0, len(texts[i]) - WIDTH + 1, 4 * block):
                start = max(0, own - 1)
                piece = texts[i][start : own + 4 * block + REACH + WIDTH]
                yield np.frombuffer(piece, np.uint8), np.array([len(piece)]), i, start
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= 8 * block and (j == i or size + len(texts[j]) <= block):
            size += len(texts[j])
            j += 1
        yield np.frombuffer(b"".join(texts[i:j]), np.uint8), np.array([len(t) for t in texts[i:j]]), i, 0
        i = j


def _own(a: dict[str, np.ndarray], start: int, block: int) -> dict[str, np.ndarray]:
    """Of a piece's segments those that start in its own blocks: a segment across a border is one piece's alone."""
    first = a["at"].astype(np.int64) - a["left"] + start
    own = start + (start > 0)
    keep = (first >= own) & (first < own + 4 * block)
    return {c: v[keep] for c, v in a.items()}


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


_COLUMNS = {"gram": np.uint64, "segment": np.uint64, "row": np.int64, "at": np.uint32, "left": np.uint8, "more": np.uint8, "settled": np.uint8}
_DEALT = "part int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _packed(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part that occurs: its entries of each column, packed."""
    order = np.argsort(part, kind="stable")
    used, cuts = np.unique(part[order], return_index=True)
    ends = np.append(cuts[1:], len(part))
    cells = [pa.array([planes(np.ascontiguousarray(x[order[a:b]]).ravel()) for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *cells], ["part", *columns])


def _unpacked(table, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.empty(0, t), *(unplanes(x, t) for x in table.column(c).to_pylist())]) for c, t in kinds.items()}


def _part_of(a: dict[str, np.ndarray], parts: int) -> np.ndarray:
    """Segments go to their anchor's part, those settled already to their row's."""
    return np.where(a["settled"] == 2, a["row"].astype(np.uint64) % np.uint64(parts), a["gram"] % np.uint64(parts)).astype(np.int64)


def _deal(parts: int, block: int | None = None):
    block = block or BLOCK  # as it is on the driver

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            rows, texts, found = batch.column("row").to_numpy(), _raw(batch.column("text")), []
            for data, sizes, first, start in _blocks(texts, block):
                a = anchors(data, sizes)
                if len(texts[first]) > 8 * block:
                    a = _own(a, start, block)
                a["row"] = rows[first + a.pop("text")]
                a["at"] = a["at"] + np.uint32(start)
                found.append(a)
            if not found:
                continue
            a = {c: np.concatenate([f[c] for f in found]) for c in _COLUMNS if c != "settled"}
            # Segments found twice here are settled here: only the first goes on to its anchor's task, so a segment
            # that most texts hold costs a row a batch there. The rest are dealt by row.
            order = np.lexsort((a["segment"], a["gram"]))
            a = {c: v[order] for c, v in a.items()}
            new = np.concatenate([[True], (a["gram"][1:] != a["gram"][:-1]) | (a["segment"][1:] != a["segment"][:-1])]) if len(order) else np.empty(0, bool)
            run_of = np.cumsum(new) - 1
            many = (np.bincount(run_of) > 1)[run_of] if len(order) else new
            a["settled"] = np.where(many, np.where(new, 1, 2), 0).astype(np.uint8)
            yield _packed(_part_of(a, parts), a)

    return run


def _redeal(parts: int):
    """Dealt segments of coarse parts, gathered until they fill a slice and dealt to finer ones."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                kept.append(_unpacked(batch.slice(i, 1), _COLUMNS))
                size += len(kept[-1]["gram"])
                if size > SLICE // 16:
                    yield _regathered(kept, parts)
                    kept, size = [], 0
        if kept:
            yield _regathered(kept, parts)

    return run


def _regathered(kept: list[dict[str, np.ndarray]], parts: int) -> pa.RecordBatch:
    a = {c: np.concatenate([k[c] for k in kept]) for c in _COLUMNS}
    return _packed(_part_of(a, parts), a)


_FOUND = "row long, start int, end int, at int, left int, more int, gram long"


@frugal_group
def _settle(table: pa.Table) -> pa.Table:
    """Covered ranges (at is null), and contexts that are wanted for anchors with unlike segments."""
    a = _unpacked(table, _COLUMNS)
    passed = a["settled"] == 2
    done = {c: v[passed] for c, v in a.items()}
    a = {c: v[~passed] for c, v in a.items()}
    order = np.lexsort((a["segment"], a["gram"]))
    a = {c: v[order] for c, v in a.items()}
    n = len(order)
    new_gram = np.concatenate([[True], a["gram"][1:] != a["gram"][:-1]]) if n else np.empty(0, bool)
    new = new_gram | np.concatenate([[True], a["segment"][1:] != a["segment"][:-1]]) if n else new_gram
    group, kind = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    covered = ((np.bincount(kind) > 1)[kind] | (a["settled"] == 1)) if n else new
    wanted = new & (np.bincount(group[new]) > 1)[group] if n else new
    both = {c: np.concatenate([done[c], a[c][covered]]) for c in ("row", "at", "left", "more")}
    start = both["at"].astype(np.int64) - both["left"]
    end = start + both["more"] + WIDTH
    w = {c: a[c][wanted] for c in a}
    null = lambda x, k, t: pa.concat_arrays([pa.nulls(k, t), pa.array(x, t)])
    k, m = len(start), int(wanted.sum()) if n else 0
    i32 = pa.int32()
    return pa.table({"row": pa.array(np.concatenate([both["row"], w["row"]])), "start": pa.concat_arrays([pa.array(start, i32), pa.nulls(m, i32)]), "end": pa.concat_arrays([pa.array(end, i32), pa.nulls(m, i32)]), "at": null(w["at"].astype(np.int32), k, i32), "left": null(w["left"].astype(np.int32), k, i32), "more": null(w["more"].astype(np.int32), k, i32), "gram": null(w["gram"].astype(np.int64), k, pa.int64())})


_SIZE = REACH + WIDTH  # bytes of a context, the anchor at REACH
_CONTEXT = {"gram": np.uint64, "row": np.int64, "at": np.int32, "left": np.uint8, "more": np.uint8, "low": np.int16, "high": np.int16}


def _contexts(parts: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE // 4):
            out: dict[str, list] = {c: [] for c in _CONTEXT}
            data = []
            wanted = batch.column("wanted")
            flat, offsets = wanted.flatten(), wanted.offsets.to_numpy() - wanted.offsets.to_numpy()[0]
            of = {c: flat.field(c).to_numpy() for c in ("gram", "at", "left", "more")}
            for k, (row, text) in enumerate(zip(batch.column("row").to_pylist(), _raw(batch.column("text")), strict=True)):
                a, b = offsets[k], offsets[k + 1]
                for at in of["at"][a:b].tolist():
                    low, high = max(0, REACH - at), min(_SIZE, len(text) - at + REACH)
                    data.append(b"\0" * low + text[at - REACH + low : at - REACH + high] + b"\0" * (_SIZE - high))
                    out["low"].append(low)
                    out["high"].append(high)
                out["row"] += [row] * (b - a)
                for c in of:
                    out[c].append(of[c][a:b])
            if not data:
                continue
            cols = {c: (np.concatenate(v).astype(t) if c in of else np.array(v, t)) for (c, t), v in zip(_CONTEXT.items(), (out[c] for c in _CONTEXT), strict=True)}
            cols["body"] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, _SIZE)
            yield _packed((cols["gram"] % np.uint64(parts)).astype(np.int64), cols)

    return run


class Construction:
    """The column-wise construction over contexts of one task, in sequential files of a folder of the task's own.

    The contexts are kept column by column. `order` has them sorted by group and by what was inserted so far, `common`
    each one's longest common prefix with the one before. A round reads one column and both files in blocks, writes the
    column's symbols in the present order (the round's share of the transform), and from these deals the contexts out by
    symbol into the files of the next round. A block has whole groups; a larger group is dealt in several blocks, the
    least common prefix since each symbol's last occurrence being carried from block to block.
    """

    def __init__(self, folder: str, n: int, block: int | None = None):
        self.n, self.block = n, block or ENTRIES
        made = lambda name, kind, *shape: np.memmap(f"{folder}/{name}", kind, "w+", shape=shape)
        self.columns = made("columns", np.uint8, _SIZE, n)
        self.hits = made("hits", bool, REACH + 1, n)
        self.transform = made("transform", np.int16, n)
        self.order, self.order_next = made("order-0", np.int64, n), made("order-1", np.int64, n)
        self.common, self.common_next = made("common-0", np.int16, n), made("common-1", np.int16, n)

    def run(self, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Fills hits: whether the window at each of the first columns of a context occurs in another of its group."""
        self.order[:] = np.argsort(group, kind="stable")
        sizes = np.bincount(group)
        for c in range(_SIZE - 1, -1, -1):
            column = np.where((c >= low) & (c < high), self.columns[c], 256).astype(np.int16)
            for a, b in self._spans(sizes):
                if b - a <= self.block:
                    self._whole_groups(a, b, column, group)
                else:
                    self._large_group(a, b, column)
            self.order, self.order_next = self.order_next, self.order
            self.common, self.common_next = self.common_next, self.common
            if c <= REACH:
                for a in range(0, self.n, self.block):
                    b = min(a + self.block, self.n)
                    hit = np.append(self.common[a : b + 1], np.zeros(1 if b == self.n else 0, np.int16)) >= WIDTH
                    self.hits[c, self.order[a:b][hit[:-1] | hit[1:]]] = True

    def _spans(self, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole groups of up to a block, or one larger group."""
        ends = np.cumsum(sizes)
        a = 0
        while a < self.n:
            i = np.searchsorted(ends, a + self.block, side="right") - 1
            b = int(ends[i]) if i >= 0 and ends[i] > a else int(ends[i + 1])
            yield a, b
            a = b

    def _whole_groups(self, a: int, b: int, column: np.ndarray, group: np.ndarray) -> None:
        order, common = np.array(self.order[a:b]), np.array(self.common[a:b])
        self.transform[a:b] = column[order]
        key = group[order] * 257 + self.transform[a:b]
        step = np.argsort(key, kind="stable")
        self.order_next[a:b] = order[step]
        self.common_next[a:b] = _next_common(key[step], step, common)

    def _large_group(self, a: int, b: int, column: np.ndarray) -> None:
        blocks = [(x, min(x + self.block, b)) for x in range(a, b, self.block)]
        count = np.zeros(257, np.int64)
        for x, y in blocks:
            self.transform[x:y] = column[self.order[x:y]]
            count += np.bincount(self.transform[x:y], minlength=257)
        at = a + np.cumsum(count) - count
        carry = np.full(257, -1, np.int64)  # least common prefix since the last one; -1: none yet
        for x, y in blocks:
            order, common, symbol = np.array(self.order[x:y]), np.array(self.common[x:y]), np.array(self.transform[x:y])
            step = np.argsort(symbol, kind="stable")
            ordered = symbol[step]
            new = _next_common(ordered, step, common)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            last = np.append(first[1:], len(ordered)) - 1
            present = ordered[first]
            before = np.minimum.accumulate(common)
            known = (carry[present] >= 0) & (present != 256)
            new[first[known]] = np.minimum(carry[present[known]], before[step[first[known]]]) + 1
            after = np.append(np.minimum.accumulate(common[::-1])[::-1][1:], np.iinfo(np.int16).max)
            carry = np.where(carry >= 0, np.minimum(carry, before[-1]), carry)
            carry[present] = after[step[last]]
            for s, i, j in zip(present.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
                to = at[s]
                self.order_next[to : to + j - i], self.common_next[to : to + j - i] = order[step[i:j]], new[i:j]
                at[s] += j - i


def _next_common(ordered: np.ndarray, step: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The common prefixes after a round, from the sorted keys, where each came from, and the prefixes before it."""
    out = np.zeros(len(step), np.int16)
    here = np.flatnonzero(np.concatenate([[False], (ordered[1:] == ordered[:-1]) & (ordered[1:] % 257 != 256)]))
    if len(here):
        out[here] = range_min(common, step[here - 1] + 1, step[here]) + 1
    return out


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b], both ends included, for many ranges."""
    level = np.floor(np.log2(b - a + 1)).astype(np.int64)
    out = np.empty(len(a), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        of = level == k
        if of.any():
            out[of] = np.minimum(table[a[of]], table[b[of] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :]) if (1 << k) < len(table) else table
    return out


@frugal_group
def _compare(table: pa.Table) -> pa.Table:
    a = _unpacked(table, _CONTEXT)
    n = len(a["gram"])
    first, column = REACH - a["left"].astype(np.int64), np.arange(REACH + 1)
    found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))]
    with tempfile.TemporaryDirectory() as folder:
        made, at = Construction(folder, n), 0
        for cell in table.column("body"):
            body = unplanes(cell.as_py(), np.uint8).reshape(-1, _SIZE)
            made.columns[:, at : at + len(body)] = body.T
            at += len(body)
        made.run(np.unique(a["gram"], return_inverse=True)[1], a["low"], a["high"])
        for x in range(0, n, made.block):
            i = slice(x, x + made.block)
            hits = np.array(made.hits[:, i]).T & (column >= first[i, None]) & (column <= (first[i] + a["more"][i])[:, None])
            edges = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            k, start = np.nonzero(edges == 1)
            _, end = np.nonzero(edges == -1)
            place = a["at"][i][k].astype(np.int64) - REACH
            found.append((a["row"][i][k], (place + start).astype(np.int32), (place + end - 1 + WIDTH).astype(np.int32)))
    return pa.table({c: pa.array(np.concatenate([f[j] for f in found])) for j, c in enumerate(("row", "start", "end"))})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of all windows of the wanted contexts: a, b, row, start."""
    for batch in slices(batches, most=SLICE // 16):
        wanted = batch.column("wanted")
        flat, offsets = wanted.flatten(), wanted.offsets.to_numpy() - wanted.offsets.to_numpy()[0]
        at, left, more = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "left", "more"))
        for k, (row, text) in enumerate(zip(batch.column("row").to_pylist(), _raw(batch.column("text")), strict=True)):
            i = slice(offsets[k], offsets[k + 1])
            n = more[i] + 1
            start = np.repeat(at[i] - left[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            data = np.frombuffer(text, np.uint8)
            a, b = (mixed(Hashes(data, base).of(start, start + WIDTH)).astype(np.int64) for base in (_BASE, _OTHER))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(start), row)), pa.array(start.astype(np.int32))], ["a", "b", "row", "start"])


def _wanted(found: DataFrame) -> DataFrame:
    return found.groupBy("row").agg(F.collect_list(F.struct("gram", "at", "left", "more")).alias("wanted"))


def _hot_windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Repeated windows (row, start, end) of anchors with very many contexts, by 128-bit digests. Digests are counted with
    partial sums, so no task gets the rows of a passage that a large share of all texts has."""
    met = written(texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(frugal(_windows), "a long, b long, row long, start int"), "hot-windows")
    often = small(written(met.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "hot-digests"))
    return met.join(often, ["a", "b"], "left_semi").select("row", "start", (F.col("start") + WIDTH).alias("end"))


def _with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, an assigned row number and the text's bytes, as a written table: every later read sees the same."""
    own = fields(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    return written(own.withColumns({"row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text")}), "rows")


def _checked(side: DataFrame, entries: str) -> DataFrame:
    n = side.agg(F.sum(F.size(entries))).first()[0] or 0
    return F.broadcast(side) if n <= BROADCAST_ENTRIES else side


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(row, ranges): each text's covered byte ranges, joined and in order. docs: as from _with_row."""
    spark = docs.sparkSession
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (docs.agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES)
    parts = -(-parts // FAN) * FAN if parts > FAN else parts  # a coarse part is so many whole finer ones
    texts = docs.filter(F.col("n_bytes") >= WIDTH).select("row", "text")
    dealt = texts.mapInArrow(_deal(min(parts, FAN)), _DEALT)
    if parts > FAN:  # else a slice would have few entries for each part
        dealt = dealt.repartition("part", F.pmod(F.xxhash64("gram"), F.lit(16))).mapInArrow(_redeal(parts), _DEALT)
    found = written(dealt.groupBy("part").applyInArrow(_settle, _FOUND), "segments")
    sought = found.filter("at is not null")
    hot = written(sought.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select("gram"), "hot-anchors")
    by_digest = None
    if not hot.isEmpty():
        hot = small(hot)
        by_digest = _hot_windows(texts, _checked(written(_wanted(sought.join(hot, "gram", "left_semi")), "wanted-hot"), "wanted"))
        sought = sought.join(hot, "gram", "left_anti")
    wanted = _checked(written(_wanted(sought), "wanted"), "wanted")
    dealt = texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(_contexts(parts), "part int, " + ", ".join(f"{c} binary" for c in _CONTEXT) + ", body binary")
    more = written(dealt.groupBy("part").applyInArrow(_compare, "row long, start int, end int"), "windows")
    more = more if by_digest is None else more.unionByName(by_digest)
    ranges = found.filter("at is null").select("row", "start", "end").unionByName(more).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    joined = F.expr("""aggregate(ranges, cast(array() as array<struct<start: int, end: int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))),
           concat(a, array(x))))""")
    return written(ranges.select("row", joined.alias("ranges")), "ranges")


@frugal
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        kept, removed, spans, sizes = [], [], [], []
        for text, ranges in zip(_raw(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            at, parts, gone = 0, [], 0
            for r in ranges or ():
                parts.append(text[at : r["start"]])
                gone, at = gone + r["end"] - r["start"], r["end"]
            parts.append(text[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(len(ranges or ()))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, as binary: a cut may
    fall within a character).

    Null text counts as empty. Texts under WIDTH bytes stay. Repeated rows are other occurrences of each other. Null
    ids stay null; an empty table gives no rows. Rows are told apart by assigned numbers; other columns aren't read.
    """
    d = _with_row(docs, id_col, text_col)
    ranges = _checked(repeated_ranges(d), "ranges")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
