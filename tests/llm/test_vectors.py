"""Vector near-duplicates against brute force."""

import numpy as np
import pytest

from stemma.llm import vector_graph


def brute(rows, least=0.98):
    ids = [r[0] for r in rows]
    linked = {i: set() for i in range(len(rows))}
    x = [np.array(r[1], float) if r[1] else np.zeros(1) for r in rows]
    fine = [r[0] is not None and r[2] is not None and bool(r[1]) and None not in r[1] and np.isfinite(v).all() and v.any() for r, v in zip(rows, x)]
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= least:
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in linked[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((ids[i], len(linked[i]), min((ids[k] for k in seen if ids[k] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1000, 40])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_graph, "SHARD", shard)
    r = np.random.default_rng(3)
    rows = []
    for c in range(25):
        v = r.normal(size=16)
        for k in range(1 if c < 15 else 40 if c == 20 else 6):
            rows.append((len(rows), [float(np.float32(y)) for y in v + r.normal(size=16) * 0.03 * k / 10], c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(4)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [], 0), (506, [1.0, 0.0], 0), (507, [2.0, 0.0], 0), (508, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], "vec_id long, embedding array<float>, label int, node string, links int").repartition(3)
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in vector_graph.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    assert vector_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_only_unusable(spark):
    got = vector_graph.near_duplicates(spark.createDataFrame([(1, None, 1), (None, [1.0], 1), (1, None, 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], x["kept"]) for x in got) == [("1", 0, True), ("1", 0, True), ("None", 0, False)]


def on_a_sphere():
    """Points all over a sphere: most have links into other clusters; some points have copies."""
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 3)) * 5
    return [(i, [float(np.float32(y)) for y in v], 1) for i, v in enumerate([*x, *x[:20], *x[:5]])]


def test_links_count_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    monkeypatch.setattr(vector_graph, "AUDIT", 1)
    rows = on_a_sphere()
    want = {i: (n, c) for i, n, c in brute(rows)}
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(n for n, _ in got.values()) % 2 == 0  # a link has two ends
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_exact_where_the_audit_sees_too_few_links(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    monkeypatch.setattr(vector_graph, "BEAM", 1)
    rows = on_a_sphere()
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in vector_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_audit_binds_and_counts_by_node(spark):
    audited = lambda rows: spark.createDataFrame(rows, "node long, truth long, found long")
    few = vector_graph.AUDIT - 1
    assert not vector_graph._enough(audited([]))
    assert not vector_graph._enough(audited([(i, 1, 1) for i in range(few)]))
    assert vector_graph._enough(audited([(i, 1, 1) for i in range(few + 1)]))
    # one node of many links does not outweigh the others
    assert not vector_graph._enough(audited([(i, 1, int(i % 10 > 0)) for i in range(few)] + [(few, 10**6, 10**6)]))
