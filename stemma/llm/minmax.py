"""Near-duplicates by min-max hashing.

A document is the set of its distinct shingles. Under each of `PERMUTATIONS` permutations both the
smallest and the largest value of the set are kept: two values for one evaluation, each an unbiased
witness of the Jaccard similarity. `ROWS` values make a band; two sets that agree on a band are
candidates. With 32 bands of 4, two sets of similarity 0.75 miss each other with a chance of 5e-6.

Sets that are equal share one digest and are represented by their smallest id from then on. In a band's
bucket of few sets all pairs are candidates; a large one is dealt into lots, and each set is paired with
the first of its bucket and of its lot and with its neighbours. Candidates whose signatures agree too
rarely for the wanted similarity are dropped, the others are confirmed on full sets.

Large buckets that are not yet one component are then finished: what lies outside the largest component
of such buckets is compared, in blocks, with all sets of other components there, first by signatures,
then on full sets, so no link between components is passed over. Only links between components leave a
task, and most near copies are in the main component by then, so thousands of them cost few comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import between, met, neighbours
from .common import batch, by_group, cut, id_text, join_anew, on_workers, pieces
from .components import components
from .words import mix as _mix
from .words import window_hashes, word_hashes

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4
#: Buckets up to this size give all their pairs.
SMALL = 4
#: Neighbours on one side that a set of a larger bucket is paired with at first.
NEAR = 2
#: Agreeing values of a signature, of 2 * PERMUTATIONS, from which a pair is confirmed on full sets. A pair
#: of similarity 0.75 has 96 on average and fewer than 74 with a chance of about 3e-6.
AGREE = 74
#: Sets of a bucket among which a set is paired with its neighbours.
LOT = 256
#: Sets, and shingles of theirs, that a task compares at once with another set or with as many others.
FEW, BLOCK = 128, 1 << 18
#: The same for blocks in which large buckets are finished.
SIDE, SIDE_BLOCK = 1024, 1 << 20
#: Characters whose words are hashed at once.
PIECE = 400_000

_ODD = (np.random.default_rng(20).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def shingles(texts: list[str], k: int = SHINGLE) -> list[np.ndarray]:
    """Sets as sorted 64-bit hashes; a text of fewer than k words is one shingle, one without words none."""
    out: list[np.ndarray] = []
    for some in pieces(texts, PIECE):
        # on bytes, lower() and white space are ASCII's
        h, words = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in some])
        full, at = window_hashes(h, k, k), 0
        for n in words.tolist():
            own = full[at : at + n - k + 1] if n >= k else window_hashes(h[at : at + n], n, n) if n else full[:0]
            out.append(np.unique(own))
            at += n
    return out


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), a 128-bit digest of the set, the hashes of its bands (null for an empty set) and a byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for texts in pieces((t.as_py() for t in b.column(1)), PIECE) for r in _signed(shingles(texts, k))]
            yield batch(_SIG, b.column(0), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])

    on_workers(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, sig binary")


def _signed(sets: list[np.ndarray]) -> list[tuple]:
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    bands = np.zeros((len(sets), 2 * PERMUTATIONS // ROWS), np.int64)
    sig = np.zeros((len(sets), 2 * PERMUTATIONS), np.uint8)
    h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        values = np.empty((len(full), 2 * PERMUTATIONS), np.uint64)
        for p in range(PERMUTATIONS):
            x = flat * _ODD[p]
            x ^= x >> np.uint64(29)
            values[:, 2 * p] = np.minimum.reduceat(x, at)
            values[:, 2 * p + 1] = np.maximum.reduceat(x, at)
        sig[full] = _mix(values).astype(np.uint8)
        for n in range(bands.shape[1]):
            h = np.full(len(full), n + 1, np.uint64)
            for j in range(ROWS):
                # a band takes values of ROWS permutations, minima and maxima by turns
                h = _mix(h ^ values[:, 2 * ((n // 2 * ROWS + j) % PERMUTATIONS) + (n + j) % 2])
            bands[full, n] = h.view(np.int64)
        h1[full] = np.add.reduceat(_mix(flat), at).view(np.int64)
        h2[full] = np.add.reduceat(_mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
    return [(int(n), int(a), int(c), list(r) if n else None, g.tobytes()) for n, a, c, r, g in zip(sizes, h1, h2, bands, sig, strict=True)]


def _alike(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for c in b.columns[3:])
            yield b.select(["a", "b", "blocks"]).filter(pa.array((x == y).sum(1) >= AGREE, pa.bool_()))

    left, right = (sigs.select(F.col("rep").alias(k), F.col("sig").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "blocks", "sa", "sb").mapInArrow(run, "a long, b long, blocks int")


def _blocks(rows: Column, shingles_: Column, sets: int, most: int) -> Column:
    """Blocks of about so many sets, or fewer where they are large."""
    return F.greatest(F.lit(1), F.ceil(rows / sets), F.ceil(shingles_ / most)).cast("int")


def _between(members: DataFrame, found: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between components that meet in large buckets, as their smallest ids.

    Blocks are compared first by signatures, and where any set of another component agrees often enough, on full sets.
    """
    both = between(members.where(F.col("m") > SMALL), found, lambda n, size: _blocks(n, size, SIDE, SIDE_BLOCK)).join(sigs.select("rep", "sig"), "rep")
    row = pa.schema([("first", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("few", pa.bool_()), ("doc_id", pa.int64()), ("label", pa.int64())])

    def agreeing(t: pa.Table) -> pa.Table:
        few, label = t.column("few").to_numpy(), t.column("label").to_numpy()
        values = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
        left, right, used = np.flatnonzero(few), np.flatnonzero(~few), np.zeros(len(few), bool)
        for i in left.tolist():
            hit = right[((values[right] == values[i]).sum(1) >= AGREE) & (label[right] != label[i])]
            used[hit] = True
            used[i] |= len(hit) > 0
        return t.select(["first", "i", "j", "few", "rep", "label"]).filter(pa.array(used)).rename_columns(row.names).cast(row)

    need = by_group(both, ["first", "i", "j"], agreeing, "first long, i int, j int, few boolean, doc_id long, label long")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        label, few = t.column("label").to_numpy(), t.column("few").to_numpy()
        own = shingles(t.column("text").to_pylist(), k)
        left, right = np.flatnonzero(few), np.flatnonzero(~few)
        size = np.array([len(s) for s in own])
        flat, owner = np.concatenate([own[i] for i in left]), np.repeat(np.arange(len(left)), size[left])
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        hits: set[tuple[int, int]] = set()
        for j in right.tolist():
            lo, hi = np.searchsorted(flat, own[j], "left"), np.searchsorted(flat, own[j], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(left))
            to = left[100 * common >= percent * (size[left] + size[j] - common)]
            hits |= {(max(x, int(label[j])), min(x, int(label[j]))) for x in set(label[to].tolist())}
        pairs = sorted(x for x in hits if x[0] != x[1])
        return pa.table([[x[0] for x in pairs], [x[1] for x in pairs]], schema=schema)

    # the same plan at every size: whether few or many sets are left, texts are dealt out to them
    sent = need.hint("merge").join(texts, "doc_id").select("first", "i", "j", "few", "label", "text")
    return by_group(sent, ["first", "i", "j"], compare, "a long, b long").distinct()


def _confirmed(texts: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b, blocks) whose full sets are that similar. Pairs meet at a, their hub, in as many blocks."""
    hub = pairs.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "blocks", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"))
    own = hub.select("hub", F.col("hub").alias("doc_id"), "blocks", "block").distinct()
    sent = hub.unionByName(own).hint("merge").join(texts, "doc_id").select("hub", "blocks", "block", "doc_id", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(t: pa.Table) -> pa.Table:
        a = t.column("hub")[0].as_py()
        sets = dict(zip(t.column("doc_id").to_pylist(), shingles(t.column("text").to_pylist(), k), strict=True))
        mine, hits = sets.pop(a), []
        for b, other in sets.items():
            both = len(np.intersect1d(mine, other, assume_unique=True)) if 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)) else 0
            if 100 * both >= percent * (len(mine) + len(other) - both) and both:
                hits.append(b)
        return pa.table([[a] * len(hits), hits], schema=schema)

    return by_group(sent, ["hub", "blocks", "block"], check, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of df.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the
    smallest id reachable. Null and empty texts, and texts without words, have empty sets and are
    linked with nothing. Repeated rows are equal sets; rows with a null id are returned with a null
    component and are not kept. An empty table gives none. Only the two named columns are read.
    """
    texts = id_text(df, id_col, text_col)
    signed = cut(signatures(df, id_col, text_col, k))
    known = signed.where("doc_id is not null and n > 0")
    classes = cut(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    sigs = classes.select("rep", "sig")
    buckets = classes.select("rep", "n", F.explode("bands").alias("value"))
    members = met(buckets)
    pairs = neighbours(members, SMALL, NEAR, LOT, _blocks(F.col("m"), F.col("m") * F.col("most"), FEW, BLOCK))
    links = _confirmed(texts, cut(_alike(pairs, sigs)), percent, k)
    found = cut(components(links))
    more = cut(_between(members, found, sigs, texts, percent, k))
    if not more.isEmpty():
        found = cut(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))
    reps = classes.select("h1", "h2", "n", "rep").join(found, classes["rep"] == found["id"], "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("doc_id is null or n = 0").select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    out = join_anew(known.select("doc_id", "n", "h1", "h2"), reps, ["h1", "h2", "n"]).select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component of near_duplicates, with all its columns; rows without an id stay.

    Where ids are repeated, the texts of an id are documents of their own: all are keyed anew, in order
    of their ids, and of rows alike in id and text one stays.
    """
    ids, null = df.where(F.col(id_col).isNotNull()), df.where(F.col(id_col).isNull())
    if ids.groupBy(F.col(id_col).cast("long")).count().where("count > 1").isEmpty():
        kept = near_duplicates(ids, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept"))
        return ids.join(kept, ids[id_col] == kept["_kept"], "left_semi").unionByName(null)
    by = ["_near_id", "_near_digest"]
    rows = ids.withColumns({"_near_id": F.col(id_col).cast("long"), "_near_digest": F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)})
    keys = cut(rows.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_near_key", F.monotonically_increasing_id()))
    texts = cut(rows.select(*by, F.col(text_col).alias("text")).join(keys, by).select("_near_key", "text"))
    kept = near_duplicates(texts, "_near_key", "text").where("kept").select(F.col("doc_id").alias("_near_key")).distinct().join(keys, "_near_key").select(*by)
    # which of rows alike in id and text stays is settled by their other columns
    order = F.xxhash64(*(F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t))
    one = rows.join(kept, by, "left_semi").withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy(order))).where("_nth = 1")
    return one.select(*df.columns).unionByName(null)
