"""Searches from many seeds at once against plain breadth-first search, and a node with very many edges."""

import random

import pytest

from stemma.operators import graph as G


def near(edges, seed, hops):
    out, front = {seed: 0}, [seed]
    for depth in range(1, hops + 1):
        front = [b for a in front for b in edges.get(a, ()) if b not in out]
        for b in front:
            out.setdefault(b, depth)
    return out


@pytest.mark.parametrize("symmetric", [True, False])
def test_like_one_by_one(spark, symmetric, monkeypatch):
    monkeypatch.setattr(G, "HUB", 5)
    r = random.Random(7)
    pairs = {(r.randrange(150), r.randrange(150)) for _ in range(160)} | {(0, k) for k in range(20)}
    pairs |= {(b, a) for a, b in pairs} if symmetric else set()
    seeds = [*range(140), 3, 3, 999]
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    df = spark.createDataFrame([(*p, 1) for p in pairs], "src long, dst long, part int").repartition(3)
    got = G.reach_all(spark.createDataFrame([(s, 1) for s in seeds] + [(None, 1)], "person_id long, bits int"), df, 4, symmetric).collect()
    assert len(got) == len({(x.seed, x.node) for x in got})
    assert {(x.seed, x.node, x.depth) for x in got} == {(s, n, d) for s in set(seeds) for n, d in near(out, s, 4).items()}


def test_a_hub(spark):
    n = 100_000
    spokes = spark.range(1, n + 1).selectExpr("0L as src", "id as dst")
    seeds = spark.range(1, 131).withColumnRenamed("id", "person_id")
    got = G.reach_all(seeds, G.both_ways(spokes), 2, symmetric=True)
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 130), (1, 130), (2, 130 * (n - 1))]


def test_no_rows(spark):
    none, some = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1,)], "person_id long")
    assert G.reach_all(some.limit(0), none, 3).count() == 0
    assert [tuple(x) for x in G.reach_all(some, none, 3).collect()] == [(1, 1, 0)]
