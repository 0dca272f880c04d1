"""Merging people against merging them one after another, the deepest first."""

import random

import pytest

from stemma.operators import apply as A
from stemma.operators import merge as M

PERSON = "person_id long, name string, gender string, birth_year int, notes string"


def one_by_one(persons, edges, belongs, mapping):
    """Each primary takes its secondaries by ord, after they have taken theirs."""
    persons = {p[0]: list(p) for p in persons}
    first = {}
    for s, p, o in sorted(mapping, key=lambda m: (m[2], m[1])):
        if s != p and s in persons and p in persons:
            first.setdefault(s, (o, p))
    children = {}
    for s, (o, p) in first.items():
        children.setdefault(p, []).append((o, s))
    edges = [list(e) for e in edges]
    belongs = set(belongs)

    def take(p):
        own = [s for _, s in sorted(children.pop(p, []))]
        for s in own:
            take(s)
        for s in own:
            a, b = persons[p], persons.pop(s)
            if a[2] in ("", "unknown") and b[2] not in ("", "unknown", None):
                a[2] = b[2]
            a[1], a[4] = (x if x else y for x, y in ((a[1], b[1]), (a[4], b[4])))
            a[3] = b[3] if a[3] is None else a[3]
            members = {p, *own}
            edges[:] = [e for e in edges if not (e[1] in members and e[2] in members and e[1] != e[2]) and not e[1] == e[2] == s]
            for e in [e for e in edges if s in e[1:3]]:
                edges.remove(e)
                turned = e[0] == "spouse" and e[2] == s
                n = [e[0], *(p if x == s else x for x in (e[1:3] if not turned else [e[2], e[1]]))]
                if not any(x[0] == n[0] and (x[1:3] == n[1:3] or n[0] == "spouse" and x[1:3] == n[:0:-1]) for x in edges):
                    edges.append(n)
            for x in [x for x in belongs if x[0] == s]:
                belongs.remove(x)
                belongs.add((p, x[1]))

    for p in [p for p in list(children) if p not in first]:
        take(p)
    return sorted(map(repr, map(tuple, persons.values()))), {(e[0], *(sorted(e[1:3]) if e[0] == "spouse" else e[1:3])) for e in edges}, belongs


def run(spark, persons, edges, belongs, mapping):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    graph = A.Graph(make(persons, PERSON), make(edges, "type string, src long, dst long, rel_id string, marriage_date string"), make(belongs, "person_id long, lineage_id long"), make([], "person_id long, branch_id long"), make([], "person_id long, doc_id long"))
    after = M.merge_people(graph, make([(*m, "clash") for m in mapping], "secondary long, primary long, ord int, person_id string"))
    own = after.edges.collect()
    ends = {(e.type, *(sorted((e.src, e.dst)) if e.type == "spouse" else (e.src, e.dst))) for e in own}
    assert len(ends) == len(own)
    return (sorted(repr(tuple(r)) for r in after.persons.collect()), ends, {tuple(r) for r in after.belongs_to.collect()}), own


def some(r, n):
    persons = [(i, r.choice(("An", "", None, f"n{i}")), r.choice(("male", "female", "unknown", "", None)), r.choice((None, None, 1800 + i)), r.choice(("", None, f"note {i}"))) for i in range(n)]
    ends = {(k, r.randrange(n), r.randrange(n)) for k in ("spouse", "parent_child") for _ in range(2 * n)}
    edges = [(k, a, b, f"{k}{a}-{b}", r.choice((None, f"day {a}-{b}"))) for k, a, b in ends if k != "spouse" or (k, b, a) not in ends or a < b]
    return persons, edges, {(i, i % 3) for i in range(n) if i % 4}


def test_like_one_by_one(spark):
    shapes = {
        "chain": [(i, i - 1, i) for i in range(1, 11)],
        "chain the other way": [(i, i + 1, 0) for i in range(10)],
        "star": [(i, 0, -i) for i in range(1, 12)],
        "tree": [(i, (i - 1) // 3, i * 7 % 5) for i in range(1, 20)],
        "odd": [(3, 3, 0), (4, 99, 0), (99, 4, 0), (5, 6, 2), (5, 7, 1), (5, 7, 1), (8, 7, None), (None, 7, 0)],
        "nothing": [],
    }
    for seed, (name, mapping) in enumerate(shapes.items()):
        persons, edges, belongs = some(random.Random(seed), 20)
        loop_free = [e for e in edges if e[1] != e[2]]
        got, own = run(spark, persons, loop_free, list(belongs), mapping)
        ordered = [(s, p, -(10**9) if o is None else o) for s, p, o in mapping if s is not None]
        assert got == one_by_one(persons, loop_free, belongs, ordered), name
        before = {(e[0], e[1], e[2]): e for e in loop_free}
        for e in own:
            if (e.type, e.src, e.dst) in before and name == "nothing":
                assert tuple(e) == before[e.type, e.src, e.dst]
        assert all(len(e.rel_id) == 24 or e.rel_id == f"{e.type}{e.src}-{e.dst}" for e in own)


def test_random_forests(spark):
    for seed in range(2):
        r = random.Random(100 + seed)
        persons, edges, belongs = some(r, 60)
        mapping = [(i, r.randrange(i), r.randrange(3)) for i in range(1, 60) if r.random() < 0.7]
        loop_free = [e for e in edges if e[1] != e[2]]
        assert run(spark, persons, loop_free, list(belongs), mapping)[0] == one_by_one(persons, loop_free, belongs, mapping)


def test_long_chain_and_circle(spark):
    n = 3000
    persons = spark.createDataFrame([(i, None, "x", None if i < n - 1 else 5, None) for i in range(n)], PERSON)
    chain = spark.createDataFrame([(i, i - 1, 0) for i in range(1, n)], "secondary long, primary long, ord int")
    places = M.merge_places(persons, chain)
    assert {(r.root, r.blocked) for r in places.collect()} == {(0, False)} and [r.person_id for r in places.orderBy("place").collect()] == list(range(1, n))
    circle = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0), (7, 8, 0)], "secondary long, primary long, ord int")
    with pytest.raises(ValueError):
        M.merge_places(persons, circle)


def test_dates_and_ids(spark):
    persons = [(i, f"n{i}", "male", None, None) for i in range(6)]
    edges = [("spouse", 5, 1, "a", "moved day"), ("spouse", 0, 5, "b", None), ("parent_child", 1, 4, "c", None), ("parent_child", 0, 1, "d", "gone"), ("parent_child", 2, 3, None, "own"), ("spouse", 0, 0, "e", None)]
    _, own = run(spark, persons, edges, [], [(1, 0, 0)])
    got = {(e.type, e.src, e.dst): (e.rel_id, e.marriage_date) for e in own}
    assert got.pop(("parent_child", 0, 4))[0] not in (None, "c")
    assert got == {("spouse", 0, 5): ("b", "moved day"), ("parent_child", 2, 3): (None, "own"), ("spouse", 0, 0): ("e", None)}
