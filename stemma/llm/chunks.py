"""Finding keys that repeat across a corpus, by chunks of documents and shards of keys.

Documents are dealt to chunks by ranges of their id, so chunks are in the order of the ids. A chunk
sends each shard of the key space one packed row of its sorted distinct keys; a shard answers each
chunk with a bit for each of these keys. However often a key occurs, a chunk sends it once, and keys of
2 bytes each, rather than rows, are what is shuffled. The chunks' texts are shuffled once, compressed
where they are read; every later step of a plan reads the same exchange.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers

#: Bytes of text in a chunk; it and some arrays of 8 bytes for each of them are in memory at once.
CHUNK_BYTES = 4 << 20
#: Keys that a shard gets.
SHARD_KEYS = 1 << 20
#: Borders taken from quantiles of the ids. Between two of them, chunks are of equal width, as many as the texts' bytes there need.
BORDERS = 1000
#: Cells of a sketch row for each key.
WIDTH = 16

ROW = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
ROW_SQL = "chunk long, shard long, data binary"
_DEALT = pa.schema([("chunk", pa.int64()), ("with_id", pa.bool_()), ("head", pa.binary()), ("size", pa.int64()), ("texts", pa.binary())])


class Plan(NamedTuple):
    """Borders of ids, and the number of the first chunk behind each; chunks for documents without an id; bytes of all texts."""

    edges: np.ndarray
    first: np.ndarray
    spare: int
    text_bytes: int

    def chunk_of(self, ids: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(self.edges, ids, "right") - 1, 0, len(self.first) - 2)
        n = np.diff(self.first)[k]
        # distances of ids as unsigned numbers: they may be as far apart as 64 bits go
        gone = (ids - self.edges[k]).view(np.uint64).astype(float)
        width = (self.edges[k + 1] - self.edges[k]).view(np.uint64).astype(float)
        return self.first[k] + np.clip(gone * n / np.maximum(width, 1), 0, n - 1).astype(np.int64)


def plan_of(texts: DataFrame) -> Plan:
    """How (doc_id, text) is dealt: one pass over the ids, one over the sizes of the texts."""
    low, high, inner = texts.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / BORDERS for i in range(1, BORDERS)], 10 * BORDERS)).first()
    edges = np.array(sorted({low or 0, *(inner or ()), high or 0}), np.int64)
    if len(edges) == 1:
        edges = np.append(edges, edges[0] + 1 if edges[0] < 2**63 - 1 else edges[0])
    shared = edges.tolist()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared), np.int64)
        at = np.array(shared, np.int64)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            k = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), len(at) - 1, np.clip(np.searchsorted(at, ids, "right") - 1, 0, len(at) - 2))
            np.add.at(total, k, b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["k", "n"])

    on_workers(texts.sparkSession)
    own = texts.select("doc_id", F.octet_length("text").cast("long").alias("n")).mapInArrow(sizes, "k long, n long")
    counted = {r.k: r.n for r in own.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # BORDERS rows at most
    # neighbouring intervals of few bytes share a chunk
    bytes_ = np.array([counted.get(k, 0) for k in range(len(edges) - 1)], np.int64)
    keep, held = [0], bytes_[0]
    for k in range(1, len(bytes_)):
        if held + bytes_[k] > CHUNK_BYTES:
            keep.append(k)
            held = 0
        held += bytes_[k]
    n = np.array([max(1, math.ceil(bytes_[a:b].sum() / CHUNK_BYTES)) for a, b in zip(keep, [*keep[1:], len(bytes_)], strict=True)])
    first = np.concatenate(([0], np.cumsum(n)))
    return Plan(np.append(edges[keep], edges[-1]), first, math.ceil(counted.get(len(edges) - 1, 0) / CHUNK_BYTES), int(sum(counted.values())))


def dealt(texts: DataFrame) -> tuple[DataFrame, Plan]:
    """Documents (doc_id, text) by chunk, compressed: a row for each chunk and batch that is read.

    Documents without an id take part in nothing and go to chunks of their own; those of one id are in one chunk.
    """
    plan = plan_of(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            chunk = plan.chunk_of(ids)
            texts_ = b.column(1).cast(pa.binary())
            seen: Counter[int] = Counter()
            for i in np.flatnonzero(null).tolist():  # by the text, repeated ones to other chunks
                h = zlib.crc32(texts_[i].as_py())
                seen[h] += 1
                chunk[i] = plan.first[-1] + (h + seen[h] - 1) % max(1, plan.spare)
            order = np.argsort(chunk, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(chunk[order]) != 0))) if len(order) else []
            rows = []
            for part in np.split(order, starts[1:]) if len(order) else []:
                own = [x.as_py() for x in texts_.take(pa.array(part))]
                blob = b"".join(own)
                head = pack(ids[part], null[part], np.array([len(x) for x in own], np.int64))
                rows.append((int(chunk[part[0]]), not null[part].all(), head, len(blob), pa.compress(blob, codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_DEALT)], schema=_DEALT)

    on_workers(texts.sparkSession)
    return texts.select("doc_id", "text").mapInArrow(run, "chunk long, with_id boolean, head binary, size long, texts binary"), plan


def numbered(df: DataFrame, plan: Plan) -> DataFrame:
    """df (longs, of which doc_id is never null) with the chunk that each row's document is in."""
    kind = ", ".join(f"{c} long" for c in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plan.chunk_of(b.column("doc_id").to_numpy()))], names=[*b.schema.names, "chunk"])

    return df.mapInArrow(run, f"{kind}, chunk long")


def ordered(t: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """A chunk's ids, null ones last, and texts in bytes, in an order that does not depend on arrival."""
    rows = []
    for head, size, packed in zip(t.column("head").to_pylist(), t.column("size").to_pylist(), t.column("texts").to_pylist(), strict=True):
        ids, null, sizes = unpack(head, np.int64, bool, np.int64)
        blob, at = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), 0
        for i, gone, n in zip(ids.tolist(), null.tolist(), sizes.tolist(), strict=True):
            rows.append((None if gone else i, blob[at : at + n]))
            at += n
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in a row, each compressed lightly."""
    out = []
    for a in arrays:
        z = zlib.compress(np.ascontiguousarray(a).tobytes(), 1)
        out += [len(z).to_bytes(4, "little"), z]
    return b"".join(out)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), t))
        at += 4 + n
    return out


def pack_bits(x: np.ndarray) -> bytes:
    return pack(np.array([len(x)], np.int64), np.packbits(x))


def unpack_bits(data: bytes) -> np.ndarray:
    n, bits = unpack(data, np.int64, np.uint8)
    return np.unpackbits(bits, count=int(n[0])).astype(bool)


class Sketch(NamedTuple):
    """A count-min sketch of `depth` rows of `1 << bits` counters, cut into `shards` ranges of cells."""

    bits: int
    depth: int
    shards: int

    @classmethod
    def of(cls, keys: int, depth: int) -> Sketch:
        return cls(max(16, math.ceil(math.log2(max(1, keys) * WIDTH))), depth, max(1, math.ceil(keys / SHARD_KEYS)))

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """Where a row counts keys: hashes of 64 bits, mixed anew for each row."""
        if row:
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[row - 1])
            keys = keys ^ (keys >> np.uint64(29))
            keys = keys * np.uint64(0xBF58476D1CE4E5B9)
        return keys >> np.uint64(64 - self.bits)

    def bounds(self, cells: np.ndarray) -> np.ndarray:
        """Where each shard's cells begin in sorted cells, and their end."""
        width = (1 << self.bits) / self.shards
        return np.searchsorted(cells, np.array([math.ceil(i * width) for i in range(self.shards)] + [1 << self.bits], np.uint64))

    def sent(self, keys: np.ndarray) -> list[tuple[int, bytes]]:
        """(shard, data): a chunk's own sketch, only the counters over 0, counts over 255 as 255."""
        out = []
        for row in range(self.depth):
            cells, counts = np.unique(self.cells(keys, row), return_counts=True)
            at = self.bounds(cells)
            for s in np.flatnonzero(np.diff(at)).tolist():
                c = cells[at[s] : at[s + 1]]
                gaps = np.diff(c, prepend=np.uint64(0))
                out.append((row * self.shards + s, pack(gaps.astype(np.uint16), (gaps >> np.uint64(16)).astype(np.uint16), (gaps >> np.uint64(32)).astype(np.uint32), np.minimum(counts[at[s] : at[s + 1]], 255).astype(np.uint8))))
        return out

    def estimates(self, keys: np.ndarray, answers: dict[int, np.ndarray]) -> np.ndarray:
        """For each key the smallest of its counters' answers."""
        low = np.full(len(keys), 255, np.uint8)
        for row in range(self.depth):
            cells, back = np.unique(self.cells(keys, row), return_inverse=True)
            got = [answers[k] for s in range(self.shards) if (k := row * self.shards + s) in answers]
            low = np.minimum(low, np.concatenate(got)[back]) if got else low
        return low


def merged(t: pa.Table, levels: tuple[int, ...]) -> pa.Table:
    """One shard: the chunks' counters added up; each chunk is told how many of levels each of its counters reaches."""
    shard = t.column("shard")[0].as_py()
    chunks, cells, counts = t.column("chunk").to_pylist(), [], []
    for d in t.column("data"):
        low, mid, high, n = unpack(d.as_py(), np.uint16, np.uint16, np.uint32, np.uint8)
        cells.append(np.cumsum(low.astype(np.uint64) | mid.astype(np.uint64) << np.uint64(16) | high.astype(np.uint64) << np.uint64(32), dtype=np.uint64))
        counts.append(n)
    flat, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(flat)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
    total = np.repeat(np.add.reduceat(n[order], starts, dtype=np.int64), np.diff(np.append(starts, len(flat))))
    reach = np.zeros(len(flat), np.uint8)
    reach[order] = sum((total >= x).astype(np.uint8) for x in levels)
    parts = np.split(reach, np.cumsum([len(c) for c in cells])[:-1])
    return pa.table([chunks, [shard] * len(chunks), [pack(p) for p in parts]], schema=ROW)


def answers(t: pa.Table) -> dict[int, np.ndarray]:
    """What merged() told a chunk, by shard."""
    return {s: unpack(d, np.uint8)[0] for s, d in zip(t.column("shard").to_pylist(), t.column("data").to_pylist(), strict=True)}


def rows(chunk: int, out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([[chunk] * len(out), [x[0] for x in out], [x[1] for x in out]], schema=ROW)
