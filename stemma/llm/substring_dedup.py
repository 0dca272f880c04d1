"""Removing repeated passages of words, with a count-min sketch before the exact pass.

Pass one counts every window of `WINDOW` words in count-min sketches, one for each chunk of documents,
which are merged by adding their counters. A window's estimate, the smallest of its counters, is never
too low, so windows estimated to occur once can be dropped without losing any that repeat. Pass two
groups exactly only what is left, by digests of 96 bits: 64 of one hash of the words and 32 of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .common import id_text, on_workers, sha256
from .words import window_hashes, word_hashes

WINDOW = 13
DEPTH = 2
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])


class _Windows:
    """All windows of a chunk's documents, in order: digests h (64 bits) and g (32 bits), and the document of each."""

    def __init__(self, t: pa.Table, width: int, second: bool = True):
        self.ids, self.texts = C.ordered(t)
        words, self.words = word_hashes(self.texts)
        self.sizes = np.maximum(0, self.words - width + 1) * np.array([i is not None for i in self.ids], np.int64)
        begin = np.concatenate(([0], np.cumsum(self.words)))[:-1]
        # windows of all texts in a row; those that begin too late in their text, or reach into the next, are left out
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(self.sizes)))[:-1], self.sizes) + np.arange(self.sizes.sum())
        self.h = window_hashes(words, width, 1)[at]
        # a hash of its own: words that one hash takes for each other are told apart by the other
        self.g = (window_hashes(word_hashes(self.texts, seed=0xD1B54A32D192ED03)[0], width, 2)[at] >> np.uint64(32)).astype(np.uint32) if second else None

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, and for each window which one it has."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return h[new], g[new], back


def _exact_shard(t: pa.Table) -> pa.Table:
    """One shard of pass two: each chunk is told which of its windows a smaller chunk has too."""
    shard = t.column("shard")[0].as_py()
    if shard < 0:
        return t.select(C.ROW.names)
    order = np.argsort(t.column("chunk").to_numpy())
    ids = t.column("chunk").to_numpy()[order]
    packed = [C.unpack(t.column("data")[int(i)].as_py(), np.uint64, np.uint32) for i in order]
    h, g = np.concatenate([p[0] for p in packed]), np.concatenate([p[1] for p in packed])
    by = np.lexsort((g, h))  # stable: equal digests stay in the order of their chunks
    first = np.concatenate(([True], (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1])))
    seen = np.empty(len(h), bool)
    seen[by] = ~first
    parts = np.split(seen, np.cumsum([len(p[0]) for p in packed])[:-1])
    return pa.table([ids, [shard] * len(ids), [C.pack_bits(p) for p in parts]], schema=C.ROW)


def remove_repeats(df: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (only if texts), kept_sha256; one row per row of df.

    A word goes if a window of width words over it also starts in a document of a smaller id. Null and
    empty texts have no words; texts shorter than a window lose nothing. Rows of one id are one
    document's: they do not remove each other's words. Rows with a null id have no order: they lose
    nothing and remove nothing. Only the two named columns are read.
    """
    on_workers(df.sparkSession)
    docs, plan = C.dealt(id_text(df, id_col, text_col))
    windows = max(1, plan.text_bytes // 5)
    sketch = C.Sketch.of(windows, DEPTH)
    shards = max(1, windows // C.SHARD_KEYS)

    def count(key: tuple, t: pa.Table) -> pa.Table:
        return C.rows(key[0].as_py(), sketch.sent(_Windows(t, width, second=False).h))

    def candidates(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        w = _Windows(t, width)
        if not len(w.h):
            return C.rows(0, [])
        maybe = sketch.estimates(w.h, C.answers(told)) > 0
        h, g, _ = _distinct(w.h[maybe], w.g[maybe])
        at = np.searchsorted(h, np.array([i * 2**64 // shards for i in range(shards)] + [2**64 - 1], np.uint64))
        at[-1] = len(h)
        chunk = key[0].as_py() if key[0].as_py() is not None else t.column("chunk")[0].as_py()
        out = [(s, C.pack(h[a:b], g[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        return C.rows(chunk, [*out, (-1 - chunk, C.pack_bits(maybe))])

    def remove(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        w = _Windows(t, width)
        starts = np.zeros(len(w.h), bool)
        if told.num_rows:
            data = dict(zip(told.column("shard").to_pylist(), told.column("data").to_pylist(), strict=True))
            maybe = C.unpack_bits(data[min(data)])
            docs_at = w.docs()[maybe]
            h, _, back = _distinct(w.h[maybe], w.g[maybe])
            seen = np.concatenate([C.unpack_bits(data[s]) for s in sorted(data) if s >= 0]) if len(h) else np.zeros(0, bool)
            first = np.full(len(h), len(w.ids), np.int64)
            np.minimum.at(first, back, docs_at)
            ids = np.array([i if i is not None else 0 for i in w.ids], np.int64)
            starts[maybe] = seen[back] | (ids[first[back]] < ids[docs_at]) if len(h) else False
        out, at = [], 0
        for text, n, doc in zip(w.texts, w.sizes.tolist(), w.ids, strict=True):
            words, removed = text.split(), 0  # bytes are split at exactly the ASCII white space
            s = np.flatnonzero(starts[at : at + n])
            at += n
            if len(s):
                gone = np.zeros(len(words) + 1, np.int64)
                gone[s] += 1
                gone[s + width] -= 1
                cover = np.cumsum(gone[:-1]) > 0
                removed, kept = int(cover.sum()), [x for x, c in zip(words, cover.tolist(), strict=True) if not c]
            left = b" ".join(kept if len(s) else words)
            out.append((doc, len(words), removed, left.decode("utf-8", "surrogatepass") if texts else None, sha256(left)))
        return pa.table([list(c) for c in zip(*out, strict=True)], schema=OUT)

    counted = docs.groupBy("chunk").applyInArrow(count, C.ROW_SQL)
    told = counted.groupBy("shard").applyInArrow(lambda t: C.merged(t, (2,)), C.ROW_SQL)
    by_chunk = docs.groupBy("chunk")
    sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(candidates, C.ROW_SQL)
    seen = sent.groupBy("shard").applyInArrow(_exact_shard, C.ROW_SQL)
    kept = by_chunk.cogroup(seen.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return kept if texts else kept.drop("kept")
