"""What must not grow with the rows behind a key: plans of operators that met large tables, and their rows."""

from pyspark.sql import functions as F

from stemma.functions import names as N
from stemma.operators import apply as A
from stemma.operators import maintenance as M
from stemma.operators import postings as P
from stemma.operators import records as R
from stemma.operators import resolve as S
from stemma.operators import retrieve as T
from stemma.plans import name_queries, registry, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_made_before_the_join(spark):
    lines = spark.sql("select array(' a ', '', concat('b', repeat('x', 400))) as content")
    none, n, nobody = F.lit(None), F.lit(3), F.array().cast(R.PERSON)
    made, = lines.select(S.body_text(F.col("content"))).first()
    assert made == "谱文(1):a\n谱文(2):b" + "x" * 299
    whole, parts = lines.select(S.rendered(n, nobody, F.col("content"), none), S.rendered(n, nobody, None, none, S.body_text(F.col("content")))).first()
    assert whole == parts == "第3页\n" + made
    assert "strategy=broadcast" in plan(registry.QUERIES["con01_rendered"](spark, SF))


def test_purged_names_a_lineage_once(spark, monkeypatch):
    seen = []
    cut = M.cut
    monkeypatch.setattr(M, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    frame = spark.createDataFrame
    tasks = frame([(1, 7), (2, 8), (3, 9), (4, 9)], "task_id long, lineage_id long")
    people = frame([(10, 1), (11, 1), (11, 4), (12, 2)], "person_id long, task_id long")
    entries = frame([(20, 1, 7), (21, 4, 8)], "entry_id long, task_id long, lineage_id long")
    lineages = frame([(7,), (8,), (9,)], "lineage_id long")
    gone = M.purged(frame([(1,), (2,), (3,)], "task_id long"), tasks, people, entries, entries.select("entry_id"), lineages, lineages.selectExpr("lineage_id", "lineage_id * 10 as branch_id"), frame([(10, 7), (10, 7), (11, 8)], "person_id long, lineage_id long"))
    got = {k: sorted(r[0] for r in df.collect()) for k, df in gone.items()}
    assert got == {"persons": [10, 12], "entries": [20], "vectors": [20], "lineages": [7], "branches": [70]}
    # below the right side of each anti join on lineages stands an aggregate
    lines = [x.lstrip(" :+-") for x in seen[-1].splitlines()]
    assert sum(x.startswith("Aggregate [lineage_id") for x in lines) >= 5


def test_containing_deals_no_rows_for_ids_that_occur_once(spark):
    people = spark.createDataFrame([(10, "ann"), (11, "bob")], "person_id long, name string")
    once = S.containing(spark.createDataFrame([(1, "ann ann"), (2, "bob")], "id long, body string"), "id", "body", people)
    assert sorted(map(tuple, once.collect())) == [(1, 10), (2, 11)]
    assert "Aggregate [id" not in plan(once)
    more = S.containing(spark.createDataFrame([(1, "ann"), (1, "ann bob"), (2, "bob"), (None, "ann"), (None, "ann")], "id long, body string"), "id", "body", people)
    assert sorted(map(repr, map(tuple, more.collect()))) == ["(1, 10)", "(1, 11)", "(2, 11)", "(None, 10)"]


def test_applied_makes_only_what_is_asked_for(spark):
    rows = lambda ddl: spark.createDataFrame([], ddl)
    person = "person_id long, name string, gender string, created_at long, birth_year int, death_year int, birth_place string, biography string"
    graph = A.Graph(spark.createDataFrame([(1, "ann", None, 1, None, None, None, None)], person), rows("type string, src long, dst long, rel_id string, marriage_date string"), rows("person_id long, lineage_id long"), rows("person_id long, branch_id long"), rows("person_id long, doc_id long"))
    tasks = spark.createDataFrame([(1, 1, 1, 1)], "task_id long, lineage_id long, branch_id long, doc_id long")
    people = spark.createDataFrame([(1, 1, " Ann ", "male", 1900, None, None, None, None), (1, 2, "Bob", "x", None, None, "here", None, True)], "task_id long, place long, name string, gender string, birth_year int, death_year int, birth_place string, biography string, confirmed boolean")
    ties = rows("task_id long, place long, type string, from_name string, to_name string, marriage_date string, confirmed boolean")
    after = A.Applied(graph, tasks, people, ties, rows("lineage_id long"), rows("branch_id long, lineage_id long"))
    assert sorted(after.persons.select("person_id", "name", "birth_year", "birth_place").collect()) == [(1, "ann", 1900, None), (2, "Bob", None, "here")]
    assert not {"mapping", "counters", "_placed"} & set(vars(after))
    assert [tuple(r) for r in after.counters.collect()] == [(1, 2, 0, 0, 0)]


def test_stripped_is_what_the_pattern_says(spark):
    texts = [None, "", " ", "a", " a b ", "a\n", "　a\u0085", " ", "a \n", "\x1ca", "a\x00", "\U0001F600 ", "x​"]
    whole = F.coalesce("t", F.lit(""))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.where(N.stripped(F.col("t")) != F.regexp_replace(whole, r"(?U)^\s+|\s+$", ""))
    keys = df.where(N.graph_key(F.col("t")) != F.lower(F.regexp_replace(whole, "[ \\t\\u3000]", "")))
    assert same.count() == keys.count() == 0


def test_vectors_are_normalised_before_they_are_copied(spark):
    v = spark.createDataFrame([(i, [float(i % 3 + 1), 1.0]) for i in range(30)], "entry_id long, vector array<double>")
    got = T.nearest_of_each(v, v.where("entry_id < 4").withColumnRenamed("entry_id", "query_id"), 6, block=7)
    lines = [x.lstrip(" :+-") for x in plan(got).splitlines()]
    copied = [i for i, x in enumerate(lines) if x.startswith("Generate explode")]
    made = [i for i, x in enumerate(lines) if x.startswith("Project") and "aggregate(" in x]
    assert len(copied) == len(made) == 2 and all(a < b for a, b in zip(copied, made, strict=True))
    best = {q: [r.entry_id for r in sorted(got.where(F.col("query_id") == q).collect(), key=lambda r: r.place)] for q in range(4)}
    assert best == {q: [i for i in range(30) if i % 3 == q % 3][:6] for q in range(4)}


def test_runs_of_one_search_are_not_sorted(spark):
    entries = spark.createDataFrame([(1, "ab", None, "the cat", 1, "active"), (2, None, "x", "a cab", None, "active"), (3, "cat", "x", "", 2, "gone")], "entry_id long, title string, type string, text string, page_no int, status string")
    index = P.runs(entries)
    assert "Sort" not in plan(index) and "Repartition" not in plan(index)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, P.build(entries).collect()))


def test_neighbours_meet_by_blocks_after_names_are_read(spark):
    lines = [x.lstrip(" :+-") for x in plan(registry.QUERIES["res08_match_scores"](spark, SF)).splitlines()]
    first = next(x for x in lines if x.startswith("Join"))
    assert first.startswith("Join Inner") and "block" in first
    assert sum(x.startswith("Join LeftOuter, (_text") for x in lines) == 2


def test_large_steps_are_spread(spark, monkeypatch):
    monkeypatch.setattr("stemma.plans.cut.ROWS", 1)
    frame = spark.createDataFrame
    listing = lambda top: frame([(f"{top}/1/a", 5, 1), (f"{top}/2/b", 7, 2), (f"{top}/2/c", 1, 3)], "path string, bytes long, mtime long")
    found = M.orphans(listing("tasks"), listing("scans"), frame([(1,)], "task_id long"), frame([(1, 4)], "entry_id long, lineage_id long"), frame([(4,)], "lineage_id long"))
    assert plan(found).count("RepartitionByExpression [name") == 4
    assert sorted((r["kind"], r["name"], r["size"], r["mtime"]) for r in found.collect()) == [("local_dir", "2", 8, "3"), ("minio_prefix", "2", 8, "3")]
    ties = frame([(1, "spouse", "a", "b"), (1, "spouse", "c", "b"), (2, "spouse", "a", "c")], "task_id long, type string, from_name string, to_name string")
    renamed = S.renamed_relations(ties, frame([(1, "c", "a"), (2, "c", "a")], "task_id long, drop string, keep string"))
    assert plan(renamed).count("RepartitionByExpression [task_id") == 3
    assert [tuple(r) for r in renamed.collect()] == [(1, "spouse", "a", "b")]
