"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared only under equal labels. Equal vectors of a label are one node. Nodes go to the
clusters of their nearest centres, two at least and all whose angle is larger than the nearest one's by
no more than the angle of a link; a cluster of more than `SHARD` nodes is dealt into several shards by a
hash of the id. In each shard every node keeps its robustly pruned neighbours: the nearest first, and
none that a kept one is much nearer to. Adjacency lists of all shards are joined into one for each node.
Every node then searches the shards of its nearest centre: greedily with a beam from the shard's medoid,
and, once a node within range is found, on through all nodes within range. Links are verified in double
precision.

Of two linked nodes, the one that is farther from its nearest centre is in the cluster where the other
one searches: no link lies outside all searched clusters. What either end finds counts for both: a
task's links go as bits to the pair of lots they lie between, where each is counted once.

Only those bits and a spanning forest of the links leave a task. Recall is audited in the tasks: one
node of `DRAWN` is compared with all nodes of its shards. If fewer than `AUDIT` of them have links, or
less than `RECALL` of the links of a node is found on average, all queries are compared with all nodes of
their shards, which leaves no link out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_anew, on_workers
from .components import components

#: Nodes of a shard, and queries that a task searches for at once.
SHARD = 1000
#: Centres of all labels together at most: the bound of what is broadcast.
CENTRES = 8192
DEGREE = 20
ALPHA = 1.2
BEAM = 16
#: One query of so many is also compared with all nodes of its shards.
DRAWN = 16
#: Drawn nodes with links from which the audit can tell the recall.
AUDIT = 256
RECALL = 0.97


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robustly pruned neighbours of every row, and the rows that keep it, -1 where there are fewer."""
    n = len(x)
    near = min(n - 1, 3 * degree)
    if near < 1:
        return np.full((n, 1), -1)
    far = np.maximum(0, 2 - 2 * (x @ x.T))
    np.fill_diagonal(far, np.inf)
    pool = np.argpartition(far, near - 1, 1)[:, :near]
    d = np.take_along_axis(far, pool, 1)
    kept, rows = np.full((n, degree), -1), np.arange(n)
    for r in range(min(degree, near)):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        p = pool[rows, best]
        kept[ok, r] = p[ok]
        d[rows, best] = np.inf
        d[(alpha**2 * far[p[:, None], pool] <= d) & np.isfinite(d)] = np.inf
        if not ok.any():
            break
    # each list also gets those that keep its node: no node is out of reach
    a, b = np.repeat(rows, degree), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    edges = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = edges // n, edges % n
    place = np.arange(len(a)) - np.searchsorted(a, a)
    order = np.lexsort((far[a, b], a))
    out = np.full((n, int(place.max()) + 1 if len(a) else 1), -1)
    out[a, place] = b[order]
    return out[:, : 3 * degree]


def range_search(q: np.ndarray, x: np.ndarray, lists: np.ndarray, start: int, least: float, beam: int = BEAM) -> np.ndarray:
    """For queries and the graph of x, a matrix of who is found within range (dot product of at least `least`)."""
    m, n = len(q), len(x)
    seen, hit = np.zeros((m, n), bool), np.zeros((m, n), bool)
    rows = np.arange(m)

    def look(who: np.ndarray, node: np.ndarray) -> np.ndarray:
        sims = np.empty(len(who))
        for a in range(0, len(who), 1 << 15):
            sims[a : a + (1 << 15)] = np.einsum("ij,ij->i", q[who[a : a + (1 << 15)]], x[node[a : a + (1 << 15)]])
        seen[who, node] = True
        hit[who, node] = sims >= least
        return sims

    beam = min(beam, n)
    ids, score, done = np.full((m, beam), start), np.full((m, beam), -np.inf), np.ones((m, beam), bool)
    score[:, 0], done[:, 0] = look(rows, np.full(m, start)), False
    while True:
        best = np.where(done, -np.inf, score).argmax(1)
        who = np.flatnonzero(~done[rows, best])
        if not len(who):
            break
        done[who, best[who]] = True
        next_ = lists[ids[who, best[who]]]
        fresh = (next_ >= 0) & ~seen[who[:, None], np.maximum(next_, 0)]
        i, j = np.nonzero(fresh)
        sims = np.full(next_.shape, -np.inf)
        if len(i):
            sims[i, j] = look(who[i], next_[i, j])
        all_ids = np.concatenate((ids[who], np.maximum(next_, 0)), 1)
        all_score, all_done = np.concatenate((score[who], sims), 1), np.concatenate((done[who], ~fresh), 1)
        top = np.argsort(-all_score, 1, kind="stable")[:, :beam]
        ids[who], score[who], done[who] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_score, all_done))
    # on through everything within range
    opened = np.zeros((m, n), bool)
    while True:
        who, node = np.nonzero(hit & ~opened)
        if not len(who):
            return hit
        opened[who, node] = True
        for a in range(0, len(who), 1 << 13):
            w, next_ = who[a : a + (1 << 13)], lists[node[a : a + (1 << 13)]]
            w = np.repeat(w, next_.shape[1])
            flat = next_.ravel()
            w, flat = w[flat >= 0], flat[flat >= 0]
            keys = np.unique(w * n + flat)
            w, flat = keys // n, keys % n
            new = ~seen[w, flat]
            if new.any():
                look(w[new], flat[new])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) enough to connect what all of them connect."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(u), find(v)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of df.

    Vectors that are null, empty or zero, that hold nulls or values that are not finite, and those with a
    null label or id are linked with nothing. Vectors of different length are never linked. Repeated
    rows count as vectors of their own. An empty table gives none. Only the three named columns are read.
    """
    spark = df.sparkSession
    on_workers(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    # -0.0 and 0.0 are one value; labels of other lengths are labels of their own
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("label", F.concat_ws("|", F.size("v").cast("string"), "label"))
    rows = cut(rows.select("vec_id", "usable", F.when(F.col("usable"), F.col("label")).alias("label"), F.when(F.col("usable"), F.col("v")).alias("v")))
    nodes = cut(rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    placed = _placed(nodes, least)
    counts, forest, audited = _search(placed, least, BEAM)
    if not _enough(audited):
        counts, forest, _ = _search(placed, least, None)
    found = components(forest)
    per = nodes.join(counts, "node", "left").join(found, nodes["node"] == found["id"], "left")
    per = per.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    # unusable vectors have no key to be joined by: they stay where they are
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_anew(rows.where("usable").select("vec_id", "label", "v"), per, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))


def _placed(nodes: DataFrame, least: float) -> DataFrame:
    """Nodes in all clusters that they belong to, with their shard there and, in their own cluster, their lot of queries."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    per = max(SHARD * 0.6, total / CENTRES)
    many = sizes.where(F.col("n") > 2 * per).select("label", F.floor(F.col("n") / per).alias("k"))
    # the nodes of the smallest hash, about k of each label: CENTRES at most, whatever the table's size
    share = nodes.join(many, "label").join(sizes, "label").where(F.pmod(F.xxhash64(F.lit("centre"), "node"), F.lit(1 << 30)) < F.col("k") / F.col("n") * (1 << 30))
    picked = share.select("label", "v").collect()
    centres: dict[str, np.ndarray] = {}
    for r in sorted(picked, key=lambda r: (r.label, list(r.v))):
        centres.setdefault(r.label, []).append(r.v)
    centres = {k: (y := np.array(v)) / np.linalg.norm(y, axis=1, keepdims=True) for k, v in centres.items()}
    shared = spark.sparkContext.broadcast(centres)
    margin = float(np.arccos(np.clip(least, -1, 1))) + 1e-6
    schema = pa.schema([("label", pa.string()), ("cluster", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64())), ("own", pa.bool_())])

    def assign(batches):
        for b in batches:
            labels, out = b.column("label").to_pylist(), []
            x = b.column("v").to_pylist()
            for i, (label, v) in enumerate(zip(labels, x, strict=True)):
                v = np.array(v)
                v /= np.linalg.norm(v)
                c = shared.value.get(label)
                if c is None or len(c) == 1:
                    out.append((label, 0, i, v, True))
                    continue
                far = np.arccos(np.clip(c @ v, -1, 1))
                order = np.argsort(far, kind="stable")
                for rank, k in enumerate(order.tolist()):
                    if rank >= 2 and far[k] > far[order[0]] + margin:
                        break
                    out.append((label, k, i, v, rank == 0))
            node, copies = b.column("node").to_pylist(), b.column("copies").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([node[o[2]] for o in out], pa.int64()), pa.array([copies[o[2]] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.list_(pa.float64())), pa.array([o[4] for o in out], pa.bool_())], schema=schema)

    placed = nodes.select("label", "node", "copies", "v").mapInArrow(assign, "label string, cluster long, node long, copies long, v array<double>, own boolean")
    clusters = placed.groupBy("label", "cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.sum(F.col("own").cast("int")) / SHARD).cast("int").alias("lots"))
    return cut(placed.join(clusters, ["label", "cluster"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")).withColumn("lot", F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest("lots", F.lit(1))).cast("int")))


def _sent(who: np.ndarray, n_who: np.ndarray, node: np.ndarray, n_node: np.ndarray, hit: np.ndarray) -> bytes:
    """Links of a block as bits, with the ids and copies of its rows and columns; what has no link stays away."""
    i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    ids = np.concatenate(([len(i), len(j)], who[i], n_who[i], node[j], n_node[j])).astype(np.int64)
    return ids.tobytes() + np.packbits(hit[np.ix_(i, j)]).tobytes()


def _merged(t: pa.Table) -> pa.Table:
    """(node, links): each link that any search between two lots found, once at both of its ends."""
    blocks = []
    for m in t.column("m").to_pylist():
        r, c = np.frombuffer(m, np.int64, 2).tolist()
        x = np.frombuffer(m, np.int64, 2 * (r + c), 16)
        bits = np.unpackbits(np.frombuffer(m, np.uint8, -1, 16 * (1 + r + c)), count=r * c).reshape(r, c).astype(bool)
        blocks.append((x[:r], x[r : 2 * r], x[2 * r : 2 * r + c], x[2 * r + c :], bits))
    ids, first = np.unique(np.concatenate([y for x in blocks for y in (x[0], x[2])]), return_index=True)
    copies = np.concatenate([y for x in blocks for y in (x[1], x[3])])[first]
    linked = np.zeros((len(ids), len(ids)), bool)
    for rows, _, columns, _, bits in blocks:
        i, j = np.searchsorted(ids, rows), np.searchsorted(ids, columns)
        linked[np.ix_(i, j)] |= bits
        linked[np.ix_(j, i)] |= bits.T
    links = np.array([int(copies[x].sum()) for x in linked], np.int64)
    return pa.table([ids, links], schema=pa.schema([("node", pa.int64()), ("links", pa.int64())]))


def _search(placed: DataFrame, least: float, beam: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, links: vectors of other nodes in range), links (a, b) that connect what is found, and for drawn nodes (node, truth, found).

    Without a beam, each query is compared with all nodes of its shards instead.
    """

    def build(t: pa.Table) -> pa.Table:
        node, x = t.column("node").to_numpy(), _vectors(t.column("v"))
        lists = [node[r[r >= 0]] for r in prune(x)]
        return pa.table([node, pa.array(lists, pa.list_(pa.int64()))], schema=pa.schema([("node", pa.int64()), ("next", pa.list_(pa.int64()))]))

    fields = ["label", "cluster", "shard", "lot", "node", "copies", "v"]
    homes = placed.where("own").select("node", F.concat_ws("|", "cluster", "lot", "label").alias("home"))
    if beam is None:
        more = homes.withColumn("next", F.array().cast("array<long>"))
    else:
        built = placed.groupBy("label", "cluster", "shard").applyInArrow(build, "node long, next array<long>")
        more = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")).join(homes, "node")
    members = placed.join(more, "node").withColumn("lot", F.explode(F.sequence(F.lit(0), F.greatest("lots", F.lit(1)) - 1))).select(*(F.col(c).alias(c) for c in (*fields, "next", "home")))
    queries = placed.where("own").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("home", F.concat_ws("|", "cluster", "lot", "label")).withColumn("drawn", F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(DRAWN)) == 0).select(*(F.col(c).alias(c) for c in (*fields, "home", "drawn")))
    result = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("truth", pa.int64()), ("found", pa.int64()), ("h1", pa.string()), ("h2", pa.string()), ("m", pa.binary())])

    def search(key: tuple, asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return result.empty_table()
        who, node, copies = asked.column("node").to_numpy(), there.column("node").to_numpy(), there.column("copies").to_numpy()
        order = np.argsort(node)
        q, x = _vectors(asked.column("v")), _vectors(there.column("v"))[order]
        node, copies = node[order], copies[order]
        n_who, home = asked.column("copies").to_numpy(), np.array(there.column("home").to_pylist(), object)[order]
        if beam is None:
            hit = q @ x.T >= least
        else:
            next_ = there.column("next").combine_chunks()
            begin = next_.offsets.to_numpy()
            flat, size = next_.flatten().to_numpy(), np.diff(begin)[order]
            lists = np.full((len(node), max(1, int(size.max()))), -1)
            for i, o in enumerate(order.tolist()):
                to = flat[begin[o] - begin[0] : begin[o + 1] - begin[0]]
                at = np.minimum(np.searchsorted(node, to), len(node) - 1)
                at = at[node[at] == to]
                lists[i, : len(at)] = at
            hit = range_search(q, x, lists, int((x @ x.mean(0)).argmax()), least, beam)
        same = who[:, None] == node[None, :]
        hit &= ~same
        out = []
        if beam is not None:
            drawn = np.flatnonzero(asked.column("drawn").to_numpy(zero_copy_only=False))
            truth = ((q[drawn] @ x.T >= least) & ~same[drawn]).sum(1)
            out += [(w, None, n, min(n, f), None, None, None) for w, n, f in zip(who[drawn].tolist(), truth.tolist(), hit[drawn].sum(1).tolist(), strict=True) if n]
        i, j = np.nonzero(hit)
        out += [(a, b, None, None, None, None, None) for a, b in _forest(who[i], node[j])]
        mine, seen = asked.column("home")[0].as_py(), np.unique(j)
        for other in sorted(set(home[seen])):
            k = seen[home[seen] == other]
            out.append((None, None, None, None, min(mine, other), max(mine, other), _sent(who, n_who, node[k], copies[k], hit[:, k])))
        return pa.table([[r[n] for r in out] for n in range(len(result))], schema=result)

    parts = ["label", "cluster", "shard", "lot"]
    done = cut(queries.groupBy(*parts).cogroup(members.groupBy(*parts)).applyInArrow(search, "a long, b long, truth long, found long, h1 string, h2 string, m binary"))
    ends = done.where("m is not null").groupBy("h1", "h2").applyInArrow(_merged, "node long, links long")
    audited = done.where("truth is not null").groupBy(F.col("a").alias("node")).agg(F.sum("truth").alias("truth"), F.sum("found").alias("found"))
    return ends.groupBy("node").agg(F.sum("links").alias("links")), done.where("b is not null").select("a", "b"), audited


def _enough(audited: DataFrame) -> bool:
    """Whether AUDIT drawn nodes with links were seen and found RECALL of their links, on average by node."""
    n, score = audited.agg(F.count("*"), F.avg(F.col("found") / F.col("truth"))).first()
    return n >= AUDIT and score >= RECALL
