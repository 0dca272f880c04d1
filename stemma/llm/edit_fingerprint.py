"""Document fingerprints by a randomised edit embedding.

A text is walked by steps 0, 1, 2, ... At each step the character under the cursor is written down, and
a random bit that depends only on the step and the character says whether the cursor moves on. All
texts share these bits, so two texts walk alike where they agree, and after an edit their cursors soon
meet again: edit distance becomes Hamming distance between what is written down (the embedding).
The bits repeat every `PERIOD` steps.

The fingerprint samples the embedding at fixed random steps, four bits of each. Steps are drawn for
length classes, powers of two; a fingerprint holds the samples of its text's class and the next
larger one, so texts up to twice as long can be compared on a class that both have. Bands of samples
propose near-duplicates, which are verified by the share of all samples that agree: an estimate of the
embeddings' Hamming distance that does not depend on how long the texts are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chunks as C
from .buckets import between, met, neighbours
from .common import batch, by_group, cut, id_text, join_anew, on_workers, pieces, sha256
from .components import components

SAMPLES = 192
PERIOD = 4096
CLASSES = 64
#: Samples of a band, and bands of each of a fingerprint's two classes.
BAND, BANDS = 6, 4
#: Likeness from which texts are near.
NEAR_LIKE = 0.75
#: Buckets up to SMALL give all their pairs; in larger ones a text meets NEAR neighbours of its lot of about LOT.
SMALL, NEAR, LOT = 4, 3, 256
#: Texts of a block in which a bucket's main component meets the others.
FEW = 2048
NARROW = 48  # below so many texts in step, they are walked one by one

_rng = np.random.default_rng(33)
_BITS = _rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
_BITS[:, ::64] = 1  # a cursor stays 64 steps at most
_twice = np.concatenate((_BITS, _BITS), 1)
_next = np.full((CLASSES, 2 * PERIOD), 255, np.int64)
for _j in range(2 * PERIOD - 2, -1, -1):
    _next[:, _j] = np.where(_twice[:, _j] == 1, 0, _next[:, _j + 1] + 1)
#: Steps that the cursor stays on a character of a class from a step on.
_STAY = (_next[:, :PERIOD] + 1).astype(np.int32).ravel()
_STAY_BYTES = _STAY.astype(np.uint8).tobytes()
_STEPS = {level: np.sort((_rng.random(SAMPLES) * (2 << level)).astype(np.int64)) for level in range(2, 42)}
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("class_id", pa.int64())])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _walk(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character the step at which the cursor reaches it, and the step after each text's last one.

    flat holds the classes of all texts' characters; text i begins there at begin[i], at step[i].
    """
    out = np.zeros(len(flat), np.int32)
    order = np.argsort(-size, kind="stable")
    at, j, n = begin[order].copy(), step[order].astype(np.int32), size[order]
    longest, i = int(n[0]) if len(n) else 0, 0
    wide = np.searchsorted(-n, -np.arange(longest), "left") if longest else np.zeros(0, np.int64)
    while i < longest and wide[i] >= NARROW:
        m = wide[i]
        p, k = at[:m], j[:m]
        out[p] = k
        k += _STAY[flat[p].astype(np.int32) * PERIOD + (k & (PERIOD - 1))]
        p += 1
        i += 1
    stay = _STAY_BYTES
    for r in range(int(wide[i]) if i < longest else 0):
        s, steps, a = int(j[r]), [], int(at[r])
        b = a + int(n[r]) - i
        for c in flat[a:b].tobytes():
            steps.append(s)
            s += stay[c * PERIOD + (s & (PERIOD - 1))]
        out[a:b] = steps
        j[r] = s
    end = np.empty(len(begin), np.int64)
    end[order] = j
    return out, end


def _level(n: int) -> int:
    return max(2, (n - 1).bit_length())


def _sampled(codes: np.ndarray, steps: np.ndarray, end: int) -> str:
    """Hexadecimal fingerprint: the length class, then its samples, then those of the next class; 0 is beyond the end."""
    level, parts = _level(len(codes)), []
    for x in (level, level + 1):
        at = _STEPS[x]
        where = np.searchsorted(steps, at, "right") - 1
        code = np.zeros(SAMPLES, np.uint64)
        inside = at < end
        h = (codes[where[inside]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (at[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        code[inside] = (h >> np.uint64(40)) % np.uint64(15) + np.uint64(1)
        parts.append("".join("0123456789abcdef"[c] for c in code.tolist()))
    return f"{level:02x}" + "".join(parts)


def likeness(a: str, b: str) -> float:
    """Share of equal samples on the classes that both have, less what chance gives; 1 for equal fingerprints, 0 for other lengths."""
    if a == b:
        return 1.0
    la, lb = int(a[:2], 16), int(b[:2], 16)
    if abs(la - lb) > 1:
        return 0.0
    low = max(la, lb)
    of = lambda f, level: f[2 + SAMPLES * (low - level) :][: SAMPLES * (2 if la == lb else 1)]
    x, y = (np.frombuffer(of(f, level).encode(), np.uint8) for f, level in ((a, la), (b, lb)))
    used = (x != 48) | (y != 48)
    if not used.any():
        return 0.0
    same = float((x == y)[used].mean())
    return min(1.0, max(0.0, (same - 1 / 15) / (14 / 15)))


def embed(texts: list[str], nexts: list[str] | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Fingerprints of texts, and of (if nexts) what texts become with their last third replaced from nexts: (text, fingerprint)."""
    codes = [_codes(t) for t in texts]
    size = np.array([len(c) for c in codes], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64)
    flat = _class(np.concatenate(codes) if codes else np.zeros(0, np.uint32))
    steps, end = _walk(flat, begin, size, np.zeros(len(texts), np.int64))
    prints = [_sampled(c, steps[b : b + n], e) for c, b, n, e in zip(codes, begin.tolist(), size.tolist(), end.tolist(), strict=True)]
    if nexts is None:
        return prints, []
    head = size - size // 3
    tails = [_codes(t[:k]) for t, k in zip(nexts, (size // 3).tolist(), strict=True)]
    # the walk of the unchanged part is known: only the new tail is walked, from the step where it begins
    tail_size = np.array([len(t) for t in tails], np.int64)
    tail_begin = np.concatenate(([0], np.cumsum(tail_size)))[:-1].astype(np.int64)
    padded = np.append(steps, 0)
    start = np.where(size // 3 > 0, padded[np.minimum(begin + head, len(steps))], end)
    tail_steps, tail_end = _walk(_class(np.concatenate(tails) if tails else np.zeros(0, np.uint32)), tail_begin, tail_size, start)
    edited = []
    for i, t in enumerate(texts):
        h, a = int(head[i]), int(tail_begin[i])
        own = np.concatenate((codes[i][:h], tails[i]))
        walked = np.concatenate((steps[begin[i] : begin[i] + h], tail_steps[a : a + len(tails[i])]))
        edited.append((t[:h] + nexts[i][: int(size[i]) // 3], _sampled(own, walked, int(tail_end[i]))))
    return prints, edited


def _class(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint; one row per row of df, where it is read. Null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out, block, n = [], [], 0
            for i, t in enumerate(texts):
                block.append(t)
                n += len(t)
                if n > 4_000_000 or i == len(texts) - 1:
                    out += embed(block)[0]
                    block, n = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(out, pa.string())], schema=schema)

    on_workers(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _previous(filled: DataFrame) -> DataFrame:
    """(to, chunk): the chunk before each one, the last for the first; by blocks of 4096 chunks."""
    rows = filled.withColumn("block", F.floor(F.col("chunk") / 4096))
    order = W.orderBy("block")  # one row for each block
    last = rows.groupBy("block").agg(F.max("chunk").alias("last"))
    before = last.select("block", F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"))
    return rows.join(before, "block").select(F.col("chunk").alias("to"), F.coalesce(F.lag("chunk").over(W.partitionBy("block").orderBy("chunk")), "before").alias("chunk"))


def against_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edit of it (its last third replaced from the next document, by descending id), and its class.

    One row per row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and class_id of near_duplicates. The last document's next one is the first. Rows of one id
    follow each other by their text, descending, and share the smallest class. A row with a null id is in
    no order and no class: its next document counts as empty. Null texts count as empty. Documents are
    dealt to chunks by ranges of ids; each chunk also gets the first document of the next non-empty chunk,
    so nothing is sorted as a whole.
    """
    own = id_text(df, id_col, text_col)
    docs, plan = C.dealt(own)
    # which document is the last of a chunk is told by ids alone; of the texts only these are sent, one for each chunk
    with_id = own.where("doc_id is not null")
    ends = C.numbered(with_id.select("doc_id"), plan).groupBy("chunk").agg(F.max("doc_id").alias("doc_id"))
    heads = with_id.join(F.broadcast(ends), "doc_id").groupBy("chunk").agg(F.max("text").alias("text"))
    none = F.lit(None).cast("long")
    following = _previous(ends.select("chunk")).join(heads, "chunk").select(F.col("to").alias("chunk"), "text", none.alias("doc_id"), none.alias("class_id"))
    dealt = C.numbered(near_duplicates(own, "doc_id", "text"), plan).select("chunk", F.lit(None).cast("string").alias("text"), "doc_id", "class_id")
    beside = following.unionByName(dealt)

    def run(key: tuple, t: pa.Table, after: pa.Table) -> pa.Table:
        if not t.num_rows:
            return FINGERPRINTS.empty_table()
        ids, raw = C.ordered(t)
        n = sum(i is not None for i in ids)
        texts = [x.decode("utf-8", "surrogatepass") for x in raw]
        ids, texts = ids[:n][::-1] + ids[n:], texts[:n][::-1] + texts[n:]
        known = {}
        for i, c in zip(after.column("doc_id").to_pylist(), after.column("class_id").to_pylist(), strict=True):
            known[i] = min(c, known.get(i, c)) if i is not None else None
        last = next((x for x in after.column("text").to_pylist() if x is not None), "")
        nexts = texts[1:n] + [last] * min(1, n) + [""] * (len(texts) - n)
        prints, edited = embed(texts, nexts)
        if n:
            tail_print = embed([last])[0][0]
        next_prints = prints[1:n] + ([tail_print] if n else []) + embed([""])[0] * (len(texts) - n)
        return pa.table([ids, [len(x) for x in texts], [sha256(e[0]) for e in edited], prints, [e[1] for e in edited], [likeness(p, e[1]) for p, e in zip(prints, edited, strict=True)], [likeness(p, q) for p, q in zip(prints, next_prints, strict=True)], [None if i is None else known[i] for i in ids]], schema=FINGERPRINTS)

    return docs.groupBy("chunk").cogroup(beside.groupBy("chunk")).applyInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("pack", pa.binary())])


def _signed(fingerprint: str) -> tuple[int, bytes]:
    """A fingerprint's digest, and its class and samples in bytes."""
    pack = bytes([int(fingerprint[:2], 16)]) + bytes.fromhex(fingerprint[2:])
    return int.from_bytes(hashlib.blake2b(pack, digest_size=8).digest(), "little", signed=True), pack


def _keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of packed fingerprints, and which fingerprint each is of; a band whose samples are all beyond the end has none."""
    samples = np.empty((len(x), 2 * SAMPLES), np.int64)
    samples[:, ::2], samples[:, 1::2] = x[:, 1:] >> 4, x[:, 1:] & 15
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2):
        for b in range(BANDS):
            at = SAMPLES * k + b * (SAMPLES // BANDS)
            bits = (samples[:, at : at + BAND] << (4 * np.arange(BAND))).sum(1)
            some = np.flatnonzero(bits)
            rows.append(some)
            keys.append(bits[some] | b << 32 | (x[some, 0].astype(np.int64) + k) << 40)
    return np.concatenate(rows), np.concatenate(keys)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """likeness() of packed fingerprints, row by row."""
    lx, ly = x[:, 0].astype(int), y[:, 0].astype(int)
    half = (x.shape[1] - 1) // 2
    out = np.zeros(len(x))
    for shift in (-1, 0, 1):
        rows = np.flatnonzero(ly - lx == shift)
        if not len(rows):
            continue
        a, b = (v[rows, 1:] if shift == 0 else v[rows, 1 + half :] if shift == s else v[rows, 1 : 1 + half] for v, s in ((x, 1), (y, -1)))
        same, used = np.zeros(len(rows)), np.zeros(len(rows))
        for p, q in ((a >> 4, b >> 4), (a & 15, b & 15)):
            filled = (p > 0) | (q > 0)
            same, used = same + ((p == q) & filled).sum(1), used + filled.sum(1)
        out[rows] = np.clip((same / np.maximum(used, 1) - 1 / 15) / (14 / 15), 0, 1)
    return out


def _packs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 1 + SAMPLES)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR_LIKE) -> DataFrame:
    """doc_id and class_id, the smallest id reachable by links; linked are texts whose fingerprints' likeness is at least `least`.

    One row per row of df with an id; others are left out. Equal texts are one class from the start. Texts
    that agree on a band are candidates; large buckets are finished in blocks, so no link between texts
    of one bucket is passed over. A link needs a band on which both texts agree, so texts with edits all
    over may be missed. An empty table gives no rows. Null texts count as empty and are one class.
    """

    def sign(batches):
        for b in batches:
            signed = [_signed(f) for some in pieces((t.as_py() for t in b.column(1)), 1_000_000) for f in embed(some)[0]]
            yield batch(_SIGNED, b.column(0), [x[0] for x in signed], [x[1] for x in signed])

    def banded(batches):
        for b in batches:
            rows, keys = _keys(_packs(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(keys)], names=["rep", "value"])

    own = id_text(df, id_col, text_col).where("doc_id is not null")
    on_workers(df.sparkSession)
    prints = cut(own.mapInArrow(sign, "doc_id long, node long, pack binary"))
    classes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("pack").alias("pack")))
    packs = classes.select("rep", "pack")
    members = met(packs.mapInArrow(banded, "rep long, value long").select("rep", F.lit(1).alias("n"), "value"))
    pairs = neighbours(members, SMALL, NEAR, LOT)
    left, right = (packs.select(F.col("rep").alias(k), F.col("pack").alias(f"p{k}")) for k in ("a", "b"))

    def verified(batches):
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array(_alike(_packs(b.column(2)), _packs(b.column(3))) >= least))

    links = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(verified, "a long, b long")
    found = cut(components(links))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        few, label, x, hits = t.column("few").to_numpy(), t.column("label").to_numpy(), _packs(t.column("pack")), set()
        right = np.flatnonzero(~few)
        for i in np.flatnonzero(few).tolist():
            to = right[label[right] != label[i]]
            near = to[_alike(x[to], np.broadcast_to(x[i], (len(to), x.shape[1]))) >= least]
            hits |= {(max(y, int(label[i])), min(y, int(label[i]))) for y in set(label[near].tolist())}
        return pa.table([[h[0] for h in sorted(hits)], [h[1] for h in sorted(hits)]], schema=schema)

    blocks = lambda count, _: F.greatest(F.lit(1), F.ceil(count / FEW)).cast("int")
    rest = between(members.where(F.col("m") > SMALL), found, blocks).join(packs, "rep").select("first", "i", "j", "few", "label", "pack")
    more = cut(by_group(rest, ["first", "i", "j"], compare, "a long, b long").distinct())
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    reps = classes.join(found, classes["rep"] == found["id"], "left").select("node", F.coalesce("component", "rep").alias("class_id"))
    return join_anew(prints.select("doc_id", "node"), reps, ["node"]).select("doc_id", "class_id")
