"""Greedy cuts in parallel against going through each group row by row."""

import random

import pytest

from stemma.operators import greedy as Y


def batches(costs, most_items, most_cost):
    out, batch, n, size = [], 0, 0, 0
    for c in costs:
        if n and (most_items is not None and n + 1 > most_items or size + c > most_cost):
            batch, n, size = batch + 1, 0, 0
        n, size = n + 1, size + c
        out.append(batch)
    return out


def chunks(sizes, budget, overlap):
    out, b = [], 0
    while b < len(sizes):
        e = b
        while e + 1 < len(sizes) and sum(sizes[b : e + 2]) <= budget:
            e += 1
        out.append((b, e))
        if e == len(sizes) - 1:
            break
        b = e + 1 - overlap if e - b + 1 > overlap else e + 1
    return out


@pytest.fixture(scope="module")
def groups():
    r = random.Random(12)
    out = {t: [r.choice((0, 1, 10, 300, 900, 2500)) for _ in range(r.randint(1, 60))] for t in range(20)}
    return out | {100: [r.choice((0, 50, 400, 1999)) for _ in range(3000)], 101: [0] * 40, 102: [5000], 103: [700] * 30}


@pytest.mark.parametrize("most_items,most_cost,small", [(12, 6000, 0), (None, 2000, 45), (3, 1, 0), (12, 6000, 10**6)])
def test_batches(spark, groups, most_items, most_cost, small, monkeypatch):
    monkeypatch.setattr(Y, "SMALL", small)
    rows = [(t, i, None if c == 0 and i % 2 else c, "x") for t, v in groups.items() for i, c in enumerate(v)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "job long, ord long, cost long, end string").repartition(5)
    got = {}
    for r in Y.batched(df, ["job"], ["ord"], "cost", most_items, most_cost).collect():
        got.setdefault(r.job, {})[r.ord] = r.batch
        assert r.end == "x"
    assert {t: [b for _, b in sorted(v.items())] for t, v in got.items()} == {t: batches(v, most_items, most_cost) for t, v in groups.items()}


@pytest.mark.parametrize("budget,overlap,small", [(2000, 2, 0), (300, 5, 45), (2000, 2, 10**6)])
def test_chunks(spark, groups, budget, overlap, small, monkeypatch):
    monkeypatch.setattr(Y, "SMALL", small)
    df = spark.createDataFrame([(t, 3 * i, c, 1) for t, v in groups.items() for i, c in enumerate(v)], "task_id long, page_no long, size long, n int").repartition(5)
    got = {}
    for r in Y.chunked(df, budget, overlap).collect():
        got.setdefault(r.task_id, []).append((r.chunk, r.first // 3, r.last // 3))
    assert {t: sorted(v) for t, v in got.items()} == {t: [(k, *c) for k, c in enumerate(chunks(v, budget, overlap))] for t, v in groups.items()}


def test_no_rows(spark):
    assert Y.batched(spark.createDataFrame([], "job long, ord long, cost long"), ["job"], ["ord"], "cost", 3, 10).count() == 0
    assert Y.chunked(spark.createDataFrame([], "task_id long, page_no long, size long")).count() == 0


def test_sums_over_ranges(spark):
    rows = [(k % 3, k, k % 7) for k in range(5000)]
    out = Y.running(spark.createDataFrame(rows, "g long, o long, v long").repartition(7), ["g"], ["o"], "v").collect()
    for g in range(3):
        n = total = 0
        for r in sorted((r for r in out if r.g == g), key=lambda r: r.o):
            n, total = n + 1, total + r.v
            assert (r.n, r.total) == (n, total)
