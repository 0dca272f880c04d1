"""Packing documents into token sequences by best-two-fit.

A sequence is filled greedily, the longest piece that still fits first. Then its smallest piece is
taken out again if two pieces that are still unpacked fill the room it leaves more tightly.

Pieces of one length are interchangeable, so the packing is found on the number of pieces of each
length, at most as many numbers as a sequence has tokens, however many documents there are: sequences
that come out alike are filled in one stroke. What each piece then needs to know is its rank among the
pieces of its length. Tasks count their own pieces of each length as they encode; the sums of these
counts over the tasks before give the rest. No group of documents meets anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import cut, id_text, on_workers

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 2048, 0


class Slot(NamedTuple):
    """Pieces of one length from the first-th on: `each` of them in each of `bins` sequences from `sequence` on, from `offset` on."""

    length: int
    first: int
    each: int
    bins: int
    sequence: int
    offset: int


def best_two_fit(counts: np.ndarray, size: int) -> list[Slot]:
    """Where the pieces go; counts[k] pieces are of length k, up to size. Each stroke uses up some length, or all but a few of it."""
    left, taken = counts.astype(np.int64), np.zeros(len(counts), np.int64)
    slots: list[Slot] = []
    sequence = 0
    while len(have := np.flatnonzero(left)):
        use: dict[int, int] = {}  # from long to short
        gap, k = size, len(have)
        while gap and (k := min(k, int(np.searchsorted(have, gap, "right"))) - 1) >= 0:
            length = int(have[k])
            use[length] = min(gap // length, int(left[length]))
            gap -= use[length] * length
        need = dict(use)
        if gap and sum(use.values()) > 1:
            pair = _tighter(have, left, use, gap, min(use))
            if pair:
                use[min(use)] -= 1
                for length in pair:
                    use[length] = use.get(length, 0) + 1
                need = {length: max(n, need.get(length, 0)) for length, n in use.items()} | {length: n for length, n in need.items() if length not in use}
        bins = min(int(left[length]) // n for length, n in need.items())
        offset = 0
        for length, n in use.items():
            if n:
                slots.append(Slot(length, int(taken[length]), n, bins, sequence, offset))
                offset += n * length
                taken[length] += n * bins
                left[length] -= n * bins
        sequence += bins
    return slots


def _tighter(have: np.ndarray, left: np.ndarray, use: dict[int, int], gap: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths that together are longer than the smallest one and fit in its place and the gap, as long as can be."""
    room = gap + smallest
    free = np.array([left[v] - use.get(int(v), 0) for v in have])
    have, free = have[(free > 0) & (have < smallest)], free[(free > 0) & (have < smallest)]
    if not len(have):
        return None
    other = np.searchsorted(have, room - have, "right") - 1
    same = (other == np.arange(len(have))) & (free < 2)
    other = np.where(same, other - 1, other)
    total = np.where(other >= 0, have + have[np.maximum(other, 0)], 0)
    best = int(np.argmax(total))
    return (int(have[best]), int(have[other[best]])) if total[best] > smallest else None


def cut_up(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or as many of size tokens as it takes behind a shorter first one."""
    first = n - (-(-n // size) - 1) * size
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pack(df: DataFrame, tokenizer_path: str, size: int = SIZE, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (with ids: the ids, too), sequence_id, offset; one row for each piece of each row of df.

    A document's tokens are its text's and `end`, which None leaves out. A null text is an empty one and
    has `end` alone (without it: no row). Documents of more than size tokens are cut; pieces of one
    sequence follow each other without a gap. Repeated rows and rows without an id are documents of
    their own. An empty table gives none. Which of two documents of one length goes to which sequence
    follows from the tasks that read them. Only the two named columns are read.
    """
    last = np.array([] if end is None else [end], np.uint32)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long" + ", ids array<int>" * ids
    plain = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * ids]
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for i, tokens in zip(b.column(0).to_pylist(), own.encode(t.as_py() for t in b.column(1)), strict=True):
                tokens = np.concatenate((tokens, last))
                for k, (start, length) in enumerate(cut_up(len(tokens), size) if len(tokens) else ()):
                    part = tokens[start : start + length]
                    rows.append((i, k, start, length, zlib.crc32(part.astype("<u4").tobytes()), block, int(seen[length]), *[part.astype(np.int32)] * ids))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(plain)], names=names)

    on_workers(df.sparkSession)
    # written once: a task's own counts belong to the rows that it has written
    pieces = cut(id_text(df, id_col, text_col).mapInArrow(run, kinds), "pieces")
    counted = cut(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(size + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[r.length] = r.n
    slots = sorted(best_two_fit(counts, size))
    at = np.array([list(s) for s in slots], np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            # the last slot of this length that begins at or before the rank
            low, high = np.searchsorted(at[:, 0], length, "left"), np.searchsorted(at[:, 0], length, "right")
            while (high - low > 1).any():
                middle = (low + high) // 2
                before = at[np.minimum(middle, len(at) - 1), 1] <= rank
                low, high = np.where(before & (high - low > 1), middle, low), np.where(before | (high - low <= 1), high, middle)
            slot = at[low]
            behind = rank - slot[:, 1]
            found = [pa.array(slot[:, 4] + behind // slot[:, 2]), pa.array(slot[:, 5] + behind % slot[:, 2] * length)]
            kept = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *found], names=[*kept, "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.select("length", "block", before.cast("long").alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "block"])  # never broadcast: offsets grow with the tasks
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    out = ", ".join(k for k in kinds.split(", ") if k.split()[0] in kept)
    return ranked.select(*kept, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, f"{out}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of the sequences of pack(ids=True): each group has the tokens of one sequence."""
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"))
