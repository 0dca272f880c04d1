"""Applying reviewed tasks against applying them one after another, row by row."""

import random

from stemma.operators import apply as A

PERSON = "person_id long, name string, gender string, created_at long, birth_year int, death_year int, birth_place string, biography string"
SAID = "task_id long, place long, name string, gender string, birth_year int, death_year int, birth_place string, biography string, confirmed boolean, side string"
TIE = "task_id long, place long, type string, from_name string, to_name string, marriage_date string, confirmed boolean, src long"


def key(name):
    return (name or "").replace(" ", "").replace("\t", "").replace(chr(0x3000), "").lower()


def one_by_one(persons, edges, belongs, inside, documents, tasks, people, relations, lineages, branches):
    persons = {p[0]: list(p) for p in persons}
    edges = {e[:3]: list(e[3:]) for e in edges}
    belongs, inside, documents = set(belongs), set(inside), set(documents)
    made = {}
    counters, mapping = [], set()

    def find(name, gender="unknown", filled=(None,) * 4):
        same = [p for p in persons.values() if key(p[1]) == key(name)]
        if same:
            p = min(same, key=lambda p: (p[0] in made, p[3] is None, p[3] or 0, p[0]))
            p[4:] = [a if a is not None else b for a, b in zip(p[4:], filled, strict=True)]
        else:
            p = [10**9 + len(made), name, gender, None, *filled]
            made[p[0]] = key(name)
            persons[p[0]] = p
        return p[0]

    def attach(pid, lineage, branch):
        if lineage is not None:
            for s in (belongs, inside):
                s.difference_update([x for x in s if x[0] == pid])
            if lineage in lineages:
                belongs.add((pid, lineage))
            if (branch, lineage) in branches:
                inside.add((pid, branch))

    for task, lineage, branch, doc in sorted(tasks):
        own, linked, done, skipped = {}, 0, 0, 0
        for r in sorted((r for r in people if r[0] == task), key=lambda r: r[1]):
            name = (r[2] or "").strip()
            if r[8] is not False and name:
                pid = find(name, r[3] if r[3] in ("male", "female") else "unknown", r[4:8])
                attach(pid, lineage, branch)
                linked += pid in own.values()
                own[name] = pid
        for r in sorted((r for r in relations if r[0] == task), key=lambda r: r[1]):
            if r[6] is False:
                continue
            kind, a, b = ((x or "").strip() for x in r[2:5])
            if kind not in ("parent_child", "spouse") or not a or not b:
                skipped += 1
                continue
            ends = []
            for name in (a, b):
                if name not in own:
                    own[name] = find(name)
                    attach(own[name], lineage, branch)
                ends.append(own[name])
            e = edges.setdefault((kind, *ends), [None, None])
            e[0], e[1] = e[0] or "new", r[5]
            done += 1
        mapping |= {(task, n, p) for n, p in own.items()}
        if doc is not None:
            documents |= {(p, doc) for p in own.values()}
        counters.append((task, len(set(own.values())), linked, done, skipped))
    top = max((p for p in persons if p not in made), default=0)
    ids = {p: top + 1 + k for k, p in enumerate(sorted(made, key=lambda p: made[p].encode()))}
    to = lambda p: ids.get(p, p)
    return (
        {(to(p[0]), *p[1:3], *p[4:]) for p in persons.values()}, {(k, to(a), to(b), *v) for (k, a, b), v in edges.items()}, {(to(p), x) for p, x in belongs}, {(to(p), x) for p, x in inside}, {(to(p), x) for p, x in documents},
        set(counters), {(t, n, to(p)) for t, n, p in mapping},
    )


def run(spark, persons, edges, belongs, inside, documents, tasks, people, relations, lineages, branches):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    graph = A.Graph(make(persons, PERSON), make(edges, "type string, src long, dst long, rel_id string, marriage_date string"), make(belongs, "person_id long, lineage_id long"), make(inside, "person_id long, branch_id long"), make(documents, "person_id long, doc_id long"))
    after, counters, mapping = A.apply_reviewed(graph, make(tasks, "task_id long, lineage_id long, branch_id long, doc_id long"), make([(*r, "clash") for r in people], SAID), make([(*r, 5) for r in relations], TIE), make([(x,) for x in lineages], "lineage_id long"), make(branches, "branch_id long, lineage_id long"))
    rows = lambda df: [tuple(r) for r in df.collect()]
    found = [rows(after.persons.drop("created_at")), [(*r[:3], r[3] and ("new" if len(r[3]) == 24 else r[3]), r[4]) for r in rows(after.edges)], rows(after.belongs_to), rows(after.in_branch), rows(after.has_document), rows(counters), rows(mapping)]
    for x in found:
        assert len(x) == len(set(x))
    return tuple(map(set, found))


def test_like_one_by_one(spark):
    for seed in range(3):
        r = random.Random(seed)
        names = ["An", "a n", "Bo", "bo ", "Cy", "Di", "Eve", "e ve", "F" + chr(0x3000) + "o", "New", "N ew", "Zed", None, " ", ""]
        name = lambda: r.choice(names)
        maybe = lambda x: x if r.random() < 0.5 else None
        persons = [(i, r.choice(names[:9] + [None]), r.choice(("male", "female", None)), maybe(r.randrange(5)), maybe(1900 + i), None, maybe("here"), None) for i in range(1, 13)]
        edges = [(k, a, b, maybe(f"r{a}"), maybe("old")) for k, a, b in {(r.choice(("spouse", "parent_child")), r.randint(1, 12), r.randint(1, 12)) for _ in range(15)}]
        tasks = [(t, maybe(r.randrange(4)), maybe(r.randrange(4)), maybe(r.randrange(3))) for t in range(12)]
        people = [(t, k, name(), r.choice(("male", "female", "x", None)), maybe(1000 + 20 * t + k), maybe(2000), maybe(f"p{t}"), maybe(f"b{t}.{k}"), r.choice((True, None, True, False))) for t in range(11) for k in range(r.randrange(5))]
        relations = [(t, k, r.choice(("spouse", " parent_child ", "cousin", None)), name(), name(), maybe(f"d{t}.{k}"), r.choice((True, None, None, False))) for t in range(11) for k in range(r.randrange(6))]
        case = (persons, edges, {(i, i % 3) for i in range(1, 9)}, {(i, i % 4) for i in range(1, 7)}, {(1, 0)}, tasks, people, relations, [0, 1, 2], {(0, 0), (1, 1), (2, 1), (3, 2)})
        case = tuple(list(x) for x in case)
        want = one_by_one(*case)
        for k, (a, b) in enumerate(zip(run(spark, *case), want, strict=True)):
            assert a == b, k


def test_no_rows(spark):
    none = ([], [], [], [], [], [], [], [], [], [])
    assert run(spark, *none) == tuple(set() for _ in range(7))
    out = run(spark, *none[:5], [(1, None, None, None)], [(1, 0, "Ann", "male", None, None, None, None, None)], [], [], [])
    assert out[0] == {(1, "Ann", "male", None, None, None, None)} and out[5] == {(1, 1, 0, 0, 0)} and out[6] == {(1, "Ann", 1)}
