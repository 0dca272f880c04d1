"""Operators that SQL cannot hold to account, and rules on texts that the tables do not have."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemma.functions import names as N
from stemma.operators import graph as G
from stemma.operators import greedy as Y
from stemma.operators import maintenance as M
from stemma.operators import readings as L
from stemma.operators import records as R
from stemma.operators import resolve as S
from stemma.operators import retrieve as T
from stemma.plans.cut import on_workers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, N.tight(F.lit(" 张　三\t丰 "))) == "张三丰"
    assert one(spark, N.duplicate_key(F.lit("\n A　b "))) == "ab"
    assert one(spark, N.question_tokens(F.lit("源流 与 迁徙历史的记载是什么 the AI x"))) == ["源流", "迁徙", "历史", "的记", "载是", "什么", "the", "AI"]
    assert one(spark, N.edit_distance(F.lit("张珊"), F.lit("张山"), 1)) == 1
    assert one(spark, N.edit_distance(F.lit("abcdef"), F.lit("xyz"), 2)) == 3


@pytest.mark.parametrize("query,name,score", [("三", "张三", 0), ("张山", "张珊", 10), ("zhangs", "张珊", 20), ("zs", "张珊", 20), ("李四海", "李四洋", 30), ("王", "张珊", None), ("", "张珊", None), ("张", "章珊", 5), ("张", "章", 10), ("zhang", "Zhangsan", None), ("Zhang", "zhang", None), ("山海", "山", None)])
def test_match_score(spark, query, name, score):
    readings = spark.createDataFrame([("章", "zhang"), ("张", "zhang"), ("三", "san"), ("山", "shan"), ("珊", "shan")], "char string, reading string")
    pairs = spark.createDataFrame([(query, name, 1)], "query string, name string, text int")
    assert [tuple(r) for r in L.fitted(pairs, readings).collect()] == [(query, name, 1, score)]
    people = spark.createDataFrame([(7, name)], "person_id long, name string")
    found = S.best_matches(spark.createDataFrame([(1, query)], "query_id long, query string"), people, readings).collect()
    assert [tuple(r) for r in found] == ([] if score is None else [(1, 7, name, score)])


def test_lenient_json():
    assert R.repaired('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert R.repaired('{"a": 1 "b": 2}') == '{"a": 1, "b": 2}'
    assert R.repaired("{'a': 'x'}") == '{"a": "x"}'
    assert R.repaired('{"a": [1, 2,],}') == '{"a": [1, 2]}'
    assert R.repaired('{"a": "it\'s, {so}" "b":[{"x":1}{"y":null}],,}') == '{"a": "it\'s, {so}", "b": [{"x": 1}, {"y": null}]}'
    assert R.repaired("{'a': 'say \"x\"', }") == '{"a": "say \\"x\\""}'
    assert R.repaired("[1]") is None and R.repaired("{broken") is None and R.repaired(None) is None


def test_audit_caps(spark):
    p = F.array(F.struct(F.lit("张□").alias("name"), F.lit("male").alias("gender"), F.lit(None).cast("int").alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.lit("").alias("birth_place"), F.lit("x").alias("biography"), F.lit(0.9).alias("confidence")), F.struct(F.lit("李四").alias("name"), F.lit("?").alias("gender"), F.lit(None).cast("int").alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.lit("").alias("birth_place"), F.lit("生1900").alias("biography"), F.lit(1.0).alias("confidence")), F.struct(F.lit("王五").alias("name"), F.lit("male").alias("gender"), F.lit(None).cast("int").alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.lit("").alias("birth_place"), F.lit(None).cast("string").alias("biography"), F.lit(1.0).alias("confidence")))
    out = one(spark, R.audited(R.people(p), F.lit("王五 字迹模糊")))
    assert [x["confidence"] for x in out] == [0.6, 0.4, 0.6]
    assert out[1]["gender"] == "unknown" and out[0]["birth_place"] is None
    assert [x["confidence"] for x in one(spark, R.audited(R.people(p), F.lit("clear")))] == [0.6, 0.4, 0.95]


def test_intents(spark):
    assert one(spark, T.intent(F.lit("张三有哪些后代"))) == "children"
    assert one(spark, T.intent(F.lit("张三的兄弟姐妹"))) == "brother"
    assert one(spark, T.intent(F.lit("hello"))) is None


def test_chunks_cover_and_move_on(spark):
    on_workers(spark)
    r = random.Random(5)
    rows = [(t, p, r.choice((10, 300, 900, 2500))) for t in range(12) for p in range(1, r.randint(2, 40))]
    got = Y.chunked(spark.createDataFrame(rows, "task_id long, page_no long, size long")).toPandas()
    for t, g in got.groupby("task_id"):
        pages = {p: s for k, p, s in rows if k == t}
        g = g.sort_values("chunk")
        assert g["first"].is_monotonic_increasing and g["first"].is_unique
        assert set().union(*(range(a, b + 1) for a, b in zip(g["first"], g["last"]))) == set(pages)
        assert all(a == b or sum(pages[p] for p in range(a, b + 1)) <= 2000 for a, b in zip(g["first"], g["last"]))
        for (_, a), (_, b) in zip(g.iloc[:-1].iterrows(), g.iloc[1:].iterrows()):
            assert b["first"] == (a["last"] - 1 if a["last"] - a["first"] + 1 > 2 else a["last"] + 1)


def test_batches(spark):
    on_workers(spark)
    rows = [(1, i, c) for i, c in enumerate([5000, 2000, 1, 1, 7000, 3])] + [(2, i, 1) for i in range(30)]
    got = Y.batched(spark.createDataFrame(rows, "job long, ord long, cost long"), ["job"], ["ord"], "cost", 12, 6000).toPandas().sort_values(["job", "ord"])
    assert got[got.job == 1]["batch"].tolist() == [0, 1, 1, 1, 2, 3]
    assert got[got.job == 2]["batch"].tolist() == [i // 12 for i in range(30)]


def test_merges_make_no_chains(spark):
    on_workers(spark)
    # what has taken others in may be dropped itself; what is dropped takes part no more
    rows = [(1, 0, "a", "b", 0.95), (1, 1, "b", "c", 0.99), (1, 2, "d", "a", 0.99), (1, 3, "e", "e", 0.99), (1, 4, "e", "f", 0.5), (1, 5, "a", "g", 0.9), (1, 6, "d", "", 0.9)]
    got = S.accepted_merges(spark.createDataFrame(rows, "task_id long, ord long, keep string, drop string, confidence double"))
    assert {(r["drop"], r["keep"]) for r in got.collect()} == {("b", "a"), ("a", "d")}


def test_merged_people_take_what_they_lack(spark):
    on_workers(spark)
    schema = "task_id long, name string, gender string, birth_year int, death_year int, birth_place string, biography string, confidence double, pages array<long>"
    rows = [(1, "a", "unknown", None, None, "", None, 0.5, [3]), (1, "b", "male", 1900, None, None, "b's", 0.7, [1, 3]), (1, "d", "unknown", None, 1950, None, None, None, [9]), (1, "x", "female", 1, 2, "here", "x's", 0.9, [4]), (2, "a", "male", 5, None, None, None, 0.3, [1])]
    merges = [(1, "b", "a", 1), (1, "a", "d", 2)]
    out = S.merged_persons(spark.createDataFrame(rows, schema), spark.createDataFrame(merges, "task_id long, drop string, keep string, place int"))
    got = {(r["task_id"], r["name"]): tuple(r)[2:] for r in out.collect()}
    assert got == {(1, "d"): ("male", 1900, 1950, None, "b's", 0.7, [1, 3, 9]), (1, "x"): ("female", 1, 2, "here", "x's", 0.9, [4]), (2, "a"): ("male", 5, None, None, None, 0.3, [1])}


def test_best_matches_against_all_pairs(spark):
    r = random.Random(8)
    both = list(zip("张章王汪三山珊丰风李", "zhang zhang wang wang san shan shan feng feng li".split(), strict=True)) + [("山", "san"), ("李", "Wang"), ("丰", "")]
    readings = spark.createDataFrame(both, "char string, reading string")
    name = lambda a, b: "".join(r.choice("张章王汪三山珊丰风李") for _ in range(r.randint(a, b)))
    people = [(i, name(1, 3) if i % 5 else r.choice(("zhangsan", "Li", "wang s"))) for i in range(60)]
    asked = [(i, r.choice((name(1, 4), name(2, 3), "zs", "ws", "zhang", "li", "", " wang "))) for i in range(80)]
    p, q = spark.createDataFrame(people, "person_id long, name string"), spark.createDataFrame(asked, "query_id long, query string")
    pairs = L.fitted(q.crossJoin(p), readings).withColumnRenamed("score", "s").where("s is not null")
    want = {(r["query_id"], r["s"], r["person_id"]) for r in pairs.groupBy("query_id").agg(F.min(F.struct("s", "person_id")).alias("m")).select("query_id", "m.*").collect()}
    got = {(r["query_id"], r["score"], r["person_id"]) for r in S.best_matches(q, p, readings).collect()}
    assert got == want


def test_states_hold(spark):
    events = [(1, 1, "start"), (1, 2, "pause"), (1, 3, "finish"), (2, 1, "start"), (2, 2, "finish"), (2, 3, "error"), (3, 1, "pause"), (3, 2, "resume"), (3, 3, "error"), (3, 4, "restart")]
    got = {r["task_id"]: r["status"] for r in M.task_states(spark.createDataFrame(events, "task_id long, at long, event string")).collect()}
    assert got == {1: "paused", 2: "done", 3: "running"}


def test_reach_against_plain_search(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)]
    got = G.reach(spark.createDataFrame([(0,), (7,)], "person_id long"), G.both_ways(spark.createDataFrame(edges, "src long, dst long")), 4)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for seed in (0, 7):
        seen, front = {seed: 0}, {seed}
        for d in range(1, 5):
            front = {y for x in front for y in near.get(x, ()) if y not in seen}
            seen |= dict.fromkeys(front, d)
        want |= {(seed, n, d) for n, d in seen.items()}
    assert {tuple(x) for x in got.select("seed", "node", "depth").collect()} == want


def test_scope_deletion_counts_agree(spark):
    belongs = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "person_id long, lineage_id long")
    inside = spark.createDataFrame([(2, 10), (4, 10), (5, 20)], "person_id long, branch_id long")
    branches = spark.createDataFrame([(10, 1, "a"), (20, 2, "b")], "branch_id long, lineage_id long, name string")
    persons = spark.createDataFrame([(i, f"p{i}") for i in range(1, 7)], "person_id long, name string")
    scope = G.scope_members(belongs, inside, branches).where("lineage_id = 1")
    left, edges = G.delete_nodes(persons, {"in_branch": inside}, scope)
    assert scope.count() + left.count() == persons.count()
    assert {r["person_id"] for r in edges["in_branch"].collect()} == {5}


def test_rerank_prefers_scores(spark):
    hits = spark.createDataFrame([(1, 0.9, None), (2, 0.8, 0.1), (3, 0.7, 0.5)], "entry_id long, sim double, score double")
    assert [r["entry_id"] for r in T.reranked(hits, "sim", "score", 3).orderBy("place").collect()] == [3, 2, 1]
    assert S.overlap_scorer(pd.Series(["a b"]), pd.Series(["b c"])).tolist() == [0.5]
