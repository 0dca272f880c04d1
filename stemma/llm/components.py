"""Connected components by contraction within tasks and pointer jumps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, on_workers

#: Links that a task contracts at once.
BATCH = 1 << 20
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("home", pa.bool_())])


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links from every id but the smallest to the smallest one that links (a, b) connect it with, and whether the id is in a."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    home = np.zeros(len(ids), bool)
    home[x] = True
    root = np.arange(len(ids))
    while len(x):
        u, v = root[x], root[y]
        low = np.minimum(u, v)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]], home[child]


def _contract(batches: Iterator[pa.RecordBatch], ordered: bool = True) -> Iterator[pa.RecordBatch]:
    """contracted() over a task's links, about BATCH at a time; if they are ordered by a, those of one a stay together."""
    held: list[pa.RecordBatch] = []

    def done(links: pa.Table) -> pa.RecordBatch:
        a, b, home = contracted(links.column("a").to_numpy(), links.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(home)], schema=_LINK)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > BATCH:
            links = pa.Table.from_batches(held)
            a = links.column("a").to_numpy()
            whole = int(np.searchsorted(a, a[-1])) if ordered else len(a)
            if whole:
                yield done(links.slice(0, whole))
                held = links.slice(whole).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in links (a, b); ids without links are absent.

    Links point from the larger id to the smaller. A round contracts the links that meet in a task, where
    all links from an id meet (its home), and replaces each link's target by what that one points to at
    its home. Before anything is shuffled, tasks contract what they read, so an id with very many links
    sends one for each task at most; links to such an id meet the one from it as plain shuffled sides,
    which Spark splits. What is left when nothing changes are links from every id to its component. The
    number of rounds grows with the logarithm of the longest path.
    """
    on_workers(links.sparkSession)
    kind = "a long, b long, home boolean"
    at_home = lambda df: cut(df.select("a", "b").repartition("a").sortWithinPartitions("a").mapInArrow(_contract, kind))
    # written first: a task that finds links in Python would keep a second worker busy by contracting them
    down = cut(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b"))
    edges, state = at_home(down.mapInArrow(lambda x: _contract(x, ordered=False), kind)), None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b", "home").cast("decimal(38,0)"))).first()) != state and now[0]:
        state = now
        target = edges.where("home").select(F.col("a").alias("b"), F.col("b").alias("to"))
        edges = at_home(edges.join(target, "b", "left").select("a", F.coalesce("to", "b").alias("b")))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

