"""Periodic runs of words, by longest common extensions on a harmonic grid.

A run of period p that is at least 2p long holds two neighbouring points jp and (j+1)p of the grid of
p. For each p and j, how far the text agrees with itself forward and backward from these two points
gives the only run of period p there can be: n/1 + n/2 + ... queries for a text of n words. A query is
answered from the suffix array of the words and the lowest common prefix between two places in it (a
sparse table of minima), backward ones from those of the reversed words. Points whose words differ have
a forward extension of 0, and nothing else is looked up for them.

The suffix array is built by prefix doubling, only groups that are still alike being sorted again.
Documents are handled many at a time; no two share a symbol, so none extends into another. All work
is done where a row is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, on_workers, sha256

#: Words a run has at least.
SHORTEST = 12
#: Words of documents that are handled together, and points of the grid.
BATCH, GRID = 1 << 17, 1 << 20

_BEST = "start long, length long, period long, exponent_milli long"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common prefixes of the suffixes of symbols (numbers from 0); a suffix ends where its document does."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, longest: int):
        n = len(symbols)
        sa = np.argsort(symbols, kind="stable").astype(np.int32)
        here = np.arange(n, dtype=np.int32)
        new = np.concatenate(([True], symbols[sa[1:]] != symbols[sa[:-1]]))
        rank = np.full(n + 1, -1, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(new, here, 0))
        levels, apart = [rank], np.zeros(n, np.int8)  # by which doubling a suffix and the next one came apart
        alike = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        while len(alike):
            at = sa[alike]
            far = at + np.int32(1 << (len(levels) - 1))
            key = (rank[at].astype(np.int64) << 32) + np.where(far < ends[at], rank[np.minimum(far, n)], -1) + 1
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            sa[alike] = at
            first = np.concatenate(([True], key[1:] != key[:-1]))
            apart[alike[:-1][first[1:] & (key[1:] >> 32 == key[:-1] >> 32)]] = len(levels)
            rank = rank.copy()
            rank[at] = alike[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            levels.append(rank)
            alike = alike[~(first & np.append(first[1:], True))]
        self.rank = rank
        self.low = self._minima(self._neighbours(sa, apart, levels), longest)
        self.log = np.zeros(longest + 2, np.int8)
        for k in range(1, int(longest + 1).bit_length()):
            self.log[1 << k :] = k

    @staticmethod
    def _neighbours(sa: np.ndarray, apart: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix and the next one in the array: halves of it that are alike, from long to short."""
        out = np.zeros(len(sa), np.int32)
        some = np.flatnonzero(apart)
        level, a, b = apart[some].astype(np.int32) - 1, sa[some], sa[np.minimum(some + 1, len(sa) - 1)]
        size = np.int32(1) << level
        for k in range(len(levels) - 2, -1, -1):
            on = np.flatnonzero(level > k)
            size[on] += (levels[k][a[on] + size[on]] == levels[k][b[on] + size[on]]).astype(np.int32) << k
        out[some] = size
        return out

    @staticmethod
    def _minima(common: np.ndarray, longest: int) -> np.ndarray:
        """Row k has the least of 1 << k values from each place on."""
        out = np.zeros((max(1, int(longest).bit_length()), len(common)), np.int32)
        out[0] = common
        for k in range(1, len(out)):
            half = 1 << (k - 1)
            out[k, : len(common) - half] = np.minimum(out[k - 1, : len(common) - half], out[k - 1, half:])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes i and j, different places of one document."""
        x, y = self.rank[i], self.rank[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        k = self.log[high - low].astype(np.int64)
        return np.minimum(self.low[k, low], self.low[k, high - (1 << k)])


def find(documents: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each document its runs (start, length, period), by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    long_ = [k for k, words in enumerate(documents) if len(words) >= max(2, shortest)]
    if not long_:
        return out
    sizes = np.array([len(documents[k]) for k in long_], np.int64)
    begin = np.cumsum(sizes) - sizes
    symbols, known = [], 0
    for k in long_:
        own = dict(zip(dict.fromkeys(documents[k]), range(known, known + len(documents[k])), strict=False))
        symbols.extend(map(own.__getitem__, documents[k]))
        known += len(own)
    symbols = np.array(symbols, np.int32)
    n, longest = len(symbols), int(sizes.max())
    forward = backward = None
    runs = [np.zeros((0, 3), np.int64)]
    for i, p, d in _same(symbols, begin, sizes):
        if not len(i):
            continue
        if forward is None:
            forward = Extensions(symbols, np.repeat(begin + sizes, sizes), longest)
            backward = Extensions(symbols[::-1].copy(), np.repeat(n - begin, sizes)[::-1].copy(), longest)
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > begin[d])
        back[inner] = backward.of(n - i[inner], n - i[inner] - p[inner])
        length = forward.of(i, i + p) + back + p
        found = np.flatnonzero((length >= 2 * p) & (length >= shortest))
        runs.append(_smallest((i - back)[found], length[found], p[found]))
    start, length, p = _smallest(*np.concatenate(runs).T).T
    order = np.lexsort((p, start))
    start, length, p = start[order], length[order], p[order]
    borders = np.searchsorted(start, np.append(begin, n))
    for k, b, x, y in zip(long_, begin.tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        out[k] = np.stack((start[x:y] - b, length[x:y], p[x:y]), 1).astype(np.int64)
    return out


def _smallest(start: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(start, length, period) of each stretch once: of the periods found for it the smallest is its period."""
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return np.stack((start[first], length[first], p[first]), 1).astype(np.int64)


def _same(symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points jp of all grids whose word is that at (j+1)p: the places, periods and documents, GRID points or one period at a time."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    many = (sizes[doc] - 1) // period
    upto = np.cumsum(many)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GRID)))
        own = many[at:to]
        which = np.repeat(np.arange(at, to), own)
        p = period[which]
        i = begin[doc[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)) * p
        same = np.flatnonzero(symbols[i] == symbols[i + p])
        yield i[same], p[same], doc[which[same]]
        at = to


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()])


def detect(df: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, then runs and collapsed, or with digests their sha256; a row per row of df.

    A run is a stretch of words (of what is between ASCII white space) with smallest period q, at least
    shortest and 2q words long, that no neighbouring word extends. Of equally long runs the first one is
    the longest, of those that with the smaller period; without a run the four are null. collapsed is
    what is left without the repeats. A null or empty text has no words, no runs and collapses to an
    empty text. Repeated rows give repeated rows, a null id stays null, an empty table gives none. Very
    long texts take some 300 bytes of memory a word. change makes other words of a document's words
    before they are looked at. Only the two named columns are read.
    """
    kinds = f"doc_id long, n_runs long, {_BEST}, " + ("runs_sha256 string, collapsed_sha256 string" if digests else "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    types = [*[pa.int64()] * 6, pa.string() if digests else pa.list_(_RUN), pa.string()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *(["runs_sha256", "collapsed_sha256"] if digests else ["runs", "collapsed"])]

    def rows(ids: list[int | None], documents: list[list[bytes]]) -> pa.RecordBatch:
        made = []
        for i, words, runs in zip(ids, documents, find(documents, shortest), strict=True):
            best: list[int | None] = [None] * 4
            if len(runs):
                k = int(np.argmax(runs[:, 1]))  # the first of the longest
                best = [*map(int, runs[k]), int(1000 * runs[k, 1] // runs[k, 2])]
            text = collapsed(words, runs)
            if digests:
                last = [sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())), sha256(text)]
            else:
                last = [[{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()], text.decode()]
            made.append((i, len(runs), *best, *last))
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        documents: list[list[bytes]] = []
        held = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = text.as_py().split()  # of bytes: by the six kinds of ASCII white space
                words = change(i, words) if change else words
                if held and held + len(words) > BATCH:
                    yield rows(ids, documents)
                    ids, documents, held = [], [], 0
                ids.append(i)
                documents.append(words)
                held += len(words)
        if ids:
            yield rows(ids, documents)

    on_workers(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, kinds)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A document's words, made periodic from some place on in one of ten documents by their ids."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
