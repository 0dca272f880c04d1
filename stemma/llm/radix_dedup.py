"""Removing repeated byte strings by a depth-limited radix sort of suffixes.

Equal strings of `LENGTH` bytes are found by ordering suffixes through that many bytes only, by
most-significant-digit passes of eight bytes: a pass sorts the rows within each group of equal digits
so far, groups of one row drop out, and what is still together at the end is equal through `LENGTH`.

Only some suffixes are sorted. In every window of `LENGTH` bytes, the 16-byte gram of the smallest hash
(the first one on ties) is its *anchor*; the same string has the same anchor at the same place t wherever
it occurs. Of the 34 bytes beside the gram, a window has 17 at least on one side: right of it if t is 17
or less, else left of it. The gram and these 17 bytes, its *side*, repeat wherever the window does. So
sides are the first digit: their counts, merged over all chunks, drop the windows whose side occurs
once. For the others, the suffixes from the anchor on, and the reversed prefixes before it, are
radix-sorted; windows that lie alike around their anchor are equal exactly if they share the group of
their suffix at depth `LENGTH - t` and that of their prefix at depth t. Within a chunk, rows that are alike
in everything, by digests of 128 bits, are sorted once.

A side that occurs `HOT` times or more may be surrounded by ever new bytes (the ends of a passage that
very many documents share). Windows of such sides are dealt to shards one by one, by a hash of all
their bytes, so that no shard grows with a side's count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .common import id_text, on_workers, sha256
from .words import mix as _mix

LENGTH = 50
GRAM = 16
HOT = 200
_PLACES = LENGTH - GRAM + 1  # places an anchor can have in a window
_LEFT = LENGTH - GRAM  # bytes before an anchor that its windows reach
_SIDE = _LEFT // 2  # bytes that a side has beside the gram
_SPAN = _LEFT + LENGTH
#: Bytes whose anchors, and rows whose surroundings, a task holds at once.
PIECE, BLOCK = 1 << 16, 1 << 15
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def digits(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of 64-bit digits, most significant first, zeros behind."""
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = rows
    return list(full.view(">u8").astype(np.uint64).T) if n else []


def radix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by most-significant-digit passes, and how many bytes each shares with the one before it."""
    n, width = rows.shape
    order, group, alive = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    for digit in digits(rows):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        d, g = digit[order[at]], group[at]
        s = np.lexsort((d, g))
        order[at], d = order[at][s], d[s]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        group[at] = np.repeat(at[starts], sizes)
        alive[at] = np.repeat(sizes > 1, sizes)
    shared = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        same = rows[order[a:b]] == rows[order[a - 1 : b - 1]]
        shared[a:b] = np.where(same.all(1), width, same.argmin(1))
    return order, shared


def _anchors(x: np.ndarray) -> np.ndarray:
    """For each window of x its anchor's place."""
    n, raw = len(x) - GRAM + 1, x.tobytes()
    h = np.ndarray((n,), "<u8", raw, 0, (1,)) * np.uint64(0x9FB21C651E98DF25)
    h += np.ndarray((n,), "<u8", raw, 8, (1,)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # the smallest hash, and on ties the first place, over _PLACES places by doubling
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= _PLACES:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    h = np.minimum(h[: len(h) - (_PLACES - span)], h[_PLACES - span :])
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sides(x: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """place, first and last window, and digest, of the right and left sides of anchors that have windows."""
    eight = np.ndarray((len(x) - 7,), "<u8", x.tobytes(), 0, (1,))
    out = []
    for seed, a, b, q in ((3, np.maximum(first, p - _SIDE), last, p), (5, first, np.minimum(last, p - _SIDE - 1), p - _SIDE)):
        has = a <= b
        at = q[has]
        h = np.full(len(at), seed, np.uint64)
        for k in (*range(0, GRAM + _SIDE - 8, 8), GRAM + _SIDE - 8):
            h = _mix(h ^ eight[at + k])
        out.append((p[has], a[has], b[has], h))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


class _Chunk:
    """Windows of a chunk's documents, gathered by side: doc, place of the anchor, first and last window, and digest of each side."""

    def __init__(self, t: pa.Table):
        self.ids, self.texts = C.ordered(t)
        self.rank = np.cumsum([False, *(a != b for a, b in zip(self.ids[1:], self.ids[:-1], strict=True))])[: len(self.ids)]
        size = np.array([len(x) for x in self.texts], np.int64)
        #: Where each text begins in all texts in a row, which have room for a context before the first and behind the last.
        self.at = np.concatenate(([0], np.cumsum(size)))[:-1] + _LEFT
        self.flat = np.frombuffer(b"".join((bytes(_LEFT), *self.texts, bytes(LENGTH))), np.uint8)
        fine = (size >= LENGTH) & np.array([i is not None for i in self.ids], bool)
        inside = np.zeros(len(self.flat) + 1, np.int8)
        np.add.at(inside, self.at[fine], 1)
        np.add.at(inside, (self.at + size - LENGTH + 1)[fine], -1)
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        parts = []
        for lo in range(0, len(self.flat) - LENGTH + 1, PIECE):  # pieces overlap by a window
            start = np.flatnonzero(inside[lo : min(lo + PIECE, len(self.flat) - LENGTH + 1)])
            if len(start):
                x = self.flat[lo : lo + PIECE + LENGTH - 1]
                where = _anchors(x)[start]
                new = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                parts.append([c + lo if k < 3 else c for k, c in enumerate(_sides(x, where[new], start[new], start[np.append(new[1:], len(start)) - 1]))])
        place, first, last, self.side = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        self.doc = (np.searchsorted(self.at, first, "right") - 1).astype(np.int32)
        self.place, self.first, self.last = ((c - self.at[self.doc]).astype(np.int32) for c in (place, first, last))

    def suffixes(self, reach: np.ndarray) -> _Rows:
        """One row for each side that repeats; a hot one has a row for each of its windows, with the window's start as its place."""
        own, hot = np.flatnonzero(reach == 1), np.flatnonzero(reach == 2)
        n = self.last[hot] - self.first[hot] + 1
        starts = np.repeat(self.first[hot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(hot) else np.zeros(0, np.int64)
        zero = np.zeros(len(starts), np.uint8)
        doc = np.concatenate((self.doc[own], np.repeat(self.doc[hot], n))).astype(np.int32)
        place = np.concatenate((self.place[own], starts)).astype(np.int32)
        least, most = (np.concatenate(((self.place[own] - x[own]).astype(np.uint8), zero)) for x in (self.last, self.first))
        return _Rows(self.flat, self.at - _LEFT, doc, place, least, most, len(own), self.side[own])


class _Rows:
    """Rows of a chunk to be sorted, those of hot sides last; rows that are alike are one kind."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, own: int, side: np.ndarray):
        self.windows, self.at = np.lib.stride_tricks.sliding_window_view(flat, _SPAN), at
        self.doc, self.place, self.least, self.most = doc, place, least, most
        n = len(doc)
        digest, self.key = np.empty(n, np.uint64), np.concatenate((side, np.empty(n - own, np.uint64)))
        for a in range(0, n, BLOCK):
            some = slice(a, min(n, a + BLOCK))
            d = digits(self.around(some))
            digest[some] = _whole(d, (least[some].astype(np.uint64) << np.uint64(8)) + most[some])
            hot = slice(max(a, own), some.stop)
            if hot.start < hot.stop:
                self.key[hot] = _whole([x[hot.start - a :] for x in d], np.full(hot.stop - hot.start, 1 << 20, np.uint64))
        is_hot = np.arange(n) >= own
        order = np.lexsort((digest, self.key, is_hot))
        k, d, z = self.key[order], digest[order], is_hot[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (z[1:] != z[:-1]))) if n else np.zeros(0, bool)
        #: The kind of each row, and the first row of each kind, in order of hot, key.
        self.kind = np.empty(n, np.int32)
        self.kind[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.hot = is_hot[self.first]

    def around(self, rows: slice | np.ndarray) -> np.ndarray:
        """Bytes around the places of rows, zero beyond what their windows reach."""
        out = self.windows[self.at[self.doc[rows]] + self.place[rows]]
        col = np.arange(_SPAN, dtype=np.uint8)
        out[(col < _LEFT - self.most[rows, None]) | (col >= _SPAN - self.least[rows, None])] = 0
        return out


def _whole(columns: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """Digests of 64 bits of rows in digits."""
    h = _mix(seed + np.uint64(7))
    for d in columns:
        h = _mix(h ^ d)
    return h


def _sort_shard(t: pa.Table) -> pa.Table:
    """One shard: radix-sort suffixes and prefixes; tell each chunk, by bits t, which windows start in a smaller document."""
    shard = t.column("shard")[0].as_py()
    if shard < 0:
        return t.select(C.ROW.names)
    chunks = t.column("chunk").to_numpy()
    packed = [C.unpack(d.as_py(), np.uint8, np.uint8, np.uint32, np.uint8) for d in t.column("data")]
    least, most = (np.concatenate([p[i] for p in packed]).astype(np.int64) for i in (0, 1))
    doc = np.concatenate([np.int64(c) << np.int64(32) | p[2].astype(np.int64) for c, p in zip(chunks, packed, strict=True)])
    around = np.concatenate([p[3] for p in packed]).reshape(-1, _SPAN)
    bits = np.zeros(len(doc), np.uint64)
    by_right, right = radix_order(around[:, _LEFT:])
    by_left, left = radix_order(around[:, :_LEFT][:, ::-1])
    for place in range(_PLACES):
        rows = np.flatnonzero((least <= place) & (place <= most))
        if not len(rows):
            continue
        suffix, prefix = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        suffix[by_right] = np.cumsum(right < LENGTH - place)
        prefix[by_left] = np.cumsum(left < place) if place else 0
        same = suffix[rows] * np.int64(len(doc) + 1) + prefix[rows]
        order = np.argsort(same)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(same[order]) != 0)))
        low = np.repeat(np.minimum.reduceat(doc[rows][order], starts), np.diff(np.append(starts, len(rows))))
        bits[rows[order]] |= (low < doc[rows][order]).astype(np.uint64) << np.uint64(place)
    parts = np.split(bits, np.cumsum([len(p[0]) for p in packed])[:-1])
    return pa.table([chunks, [shard] * len(chunks), [C.pack(p) for p in parts]], schema=C.ROW)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes; only if texts), kept_sha256; one row per row of df.

    A byte of a text's UTF-8 form goes if a string of LENGTH bytes over it also starts in a document of
    a smaller id. Null and empty texts have no bytes; texts shorter than LENGTH lose nothing. Rows of
    one id are one document's and do not remove each other's bytes; rows with a null id lose nothing and
    remove nothing. kept may end within a character, so it is binary. Only the two named columns are read.
    """
    on_workers(df.sparkSession)
    docs, plan = C.dealt(id_text(df, id_col, text_col))
    anchors = max(1, plan.text_bytes * 2 // (_PLACES + 1))
    sketch = C.Sketch.of(2 * anchors, 1)
    shards = max(1, anchors // (1 << 18))

    def count(key: tuple, t: pa.Table) -> pa.Table:
        return C.rows(key[0].as_py(), sketch.sent(_Chunk(t).side))

    def suffixes(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return C.rows(0, [])
        c, chunk = _Chunk(t), t.column("chunk")[0].as_py()
        if not len(c.side):
            return C.rows(0, [])
        reach = sketch.estimates(c.side, C.answers(told))
        x = c.suffixes(reach)
        shard = (x.key[x.first] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        shard = shard.astype(np.int64) + shards * x.hot
        out = [(-1 - chunk, C.pack(reach))]
        for s, a, b in zip(*(v.tolist() for v in _runs(shard)), strict=True):
            f = x.first[a:b]
            out.append((s, C.pack(x.least[f], x.most[f], c.rank[x.doc[f]].astype(np.uint32), x.around(f))))
        return C.rows(chunk, out)

    def remove(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return OUT.empty_table()
        c, gone = _Chunk(t), {}
        if told.num_rows:
            data = dict(zip(told.column("shard").to_pylist(), told.column("data").to_pylist(), strict=True))
            x = c.suffixes(C.unpack(data[min(data)], np.uint8)[0])
            bits = np.concatenate([C.unpack(data[s], np.uint64)[0] for s in sorted(data) if s >= 0]) if len(x.first) else np.zeros(0, np.uint64)
            mine = bits[x.kind]
            # rows alike to one of a smaller document in this chunk: all their windows
            if len(x.first):
                mine[c.rank[x.doc] > c.rank[x.doc[x.first]][x.kind]] = 2**64 - 1
            hit_doc, hit_start = [], []
            for k in range(_PLACES):
                rows = np.flatnonzero((mine >> np.uint64(k) & np.uint64(1)).astype(bool) & (x.least <= k) & (k <= x.most))
                hit_doc.append(x.doc[rows])
                hit_start.append(x.place[rows] - k)
            hit_doc, hit_start = np.concatenate(hit_doc), np.concatenate(hit_start)
            order = np.argsort(hit_doc, kind="stable")
            hit_doc, hit_start = hit_doc[order], hit_start[order]
            for i, a, b in zip(*(x.tolist() for x in _runs(hit_doc)), strict=True):
                gone[i] = hit_start[a:b]
        out = []
        for i, x in enumerate(c.texts):
            if i not in gone:
                out.append((c.ids[i], len(x), 0, 0, x if texts else None, sha256(x)))
                continue
            d = np.zeros(len(x) + 1, np.int32)
            np.add.at(d, gone[i], 1)
            np.add.at(d, gone[i] + LENGTH, -1)
            cover = np.cumsum(d[:-1]) > 0
            left = np.frombuffer(x, np.uint8)[~cover].tobytes()
            spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
            out.append((c.ids[i], len(x), int(cover.sum()), spans, left if texts else None, sha256(left)))
        return pa.table([list(col) for col in zip(*out, strict=True)], schema=OUT)

    by_chunk = docs.groupBy("chunk")
    counted = by_chunk.applyInArrow(count, C.ROW_SQL)
    told = counted.groupBy("shard").applyInArrow(lambda t: C.merged(t, (2, HOT)), C.ROW_SQL)
    sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(suffixes, C.ROW_SQL)
    seen = sent.groupBy("shard").applyInArrow(_sort_shard, C.ROW_SQL)
    kept = by_chunk.cogroup(seen.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return kept if texts else kept.drop("kept")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value, begin and end of each run of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[starts], starts, np.append(starts[1:], len(x)) if len(x) else starts
