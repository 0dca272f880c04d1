"""Queries on names in whole texts and on their readings: names of ideographs, made of customers, and a table of four thousand readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import readings as L
from ..operators import resolve as S
from ..operators import retrieve as T
from ..operators.apply import numbered
from .cut import cut, spread
from .registry import query

#: The first of the ideographs that have readings here, and how many of them.
BASE, MANY = 30400, 4000
#: Ids of a block in which neighbours are looked for.
BLOCK = 47
HEADS = "b p m f d t n l g k h j q x zh ch sh r z c".split()
TAILS = "a o e i u an en ang eng ai ei ao".split()
#: What is asked around a name; all of it are words of relationship and asking.
ASKING = "的父亲是谁"

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: v: the readings r (c, ord, reading), people n (person_id, a, b, c: characters by number, c for some), their readings w (person_id, f, i), those of each character s.
_VIEWS = f"""r AS (SELECT {BASE} + i AS c, 0 AS ord, {_LIST(HEADS)}[CAST(i % 20 + 1 AS BIGINT)] || {_LIST(TAILS)}[CAST(i // 20 % 12 + 1 AS BIGINT)] AS reading FROM range({MANY}) t(i)
 UNION ALL SELECT {BASE} + i, 1, {_LIST(HEADS)}[CAST((i * 3 + 1) % 20 + 1 AS BIGINT)] || {_LIST(TAILS)}[CAST((i + 5) % 12 + 1 AS BIGINT)] FROM range({MANY}) t(i) WHERE i % 7 = 0),
n AS (SELECT person_id, {BASE} + person_id % 90 AS a, {BASE} + (person_id * 31) % {MANY} AS b, CASE WHEN person_id % 3 = 0 THEN {BASE} + (person_id * 17) % 61 END AS c FROM v_persons),
p AS (SELECT *, chr(CAST(a AS INT)) || chr(CAST(b AS INT)) || coalesce(chr(CAST(c AS INT)), '') AS name FROM n),
w AS (SELECT DISTINCT person_id, x.reading || y.reading || coalesce(z.reading, '') AS f, left(x.reading, 1) || left(y.reading, 1) || left(coalesce(z.reading, ''), 1) AS i FROM n JOIN r x ON x.c = n.a JOIN r y ON y.c = n.b LEFT JOIN r z ON z.c = n.c)"""
#: Who asks for whom: a whole name, the beginning of its reading, a name with another character at its end, a character read like its first.
_ASKED = f"""k AS (SELECT person_id, min(f) AS f FROM w GROUP BY 1),
q AS (SELECT p.person_id AS id, CASE p.person_id % 4 WHEN 0 THEN name WHEN 1 THEN upper(left(k.f, 5)) WHEN 2 THEN left(name, length(name) - 1) || chr({BASE + MANY + 7}) ELSE chr(CAST(a + 240 AS INT)) END AS q, p.person_id % 4 AS kind, a FROM p JOIN k USING (person_id)),
pairs AS (SELECT q.id, p.person_id, CASE WHEN contains(p.name, q.q) THEN 0 WHEN kind = 1 THEN CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.person_id = p.person_id AND (starts_with(w.f, lower(q.q)) OR starts_with(w.i, lower(q.q)))) THEN 20 END
 WHEN kind IN (0, 2) THEN CASE WHEN kind = 0 AND EXISTS (SELECT 1 FROM w x JOIN w y ON y.f = x.f WHERE x.person_id = q.id AND y.person_id = p.person_id) THEN 10 WHEN EXISTS (SELECT 1 FROM range(4) t(i) WHERE left(q.q, i) || substr(q.q, i + 2) = p.name OR left(p.name, i) || substr(p.name, i + 2) = q.q OR length(q.q) = length(p.name) AND left(q.q, i) || substr(q.q, i + 2) = left(p.name, i) || substr(p.name, i + 2)) THEN 30 END WHEN kind = 3 THEN CASE WHEN EXISTS (SELECT 1 FROM w JOIN r ON r.c = q.a + 240 WHERE w.person_id = p.person_id AND starts_with(w.f, r.reading)) THEN 5 END END AS score
 FROM q CROSS JOIN p)"""


def _letter(n) -> F.col:
    """The character of a number; Spark's own chr() ends at 255."""
    return F.decode(F.unhex(F.hex(n)), "UTF-16BE")


def _readings(m) -> DataFrame:
    i = F.col("id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    own = m.spark.range(MANY)
    first = own.select(_letter(i + BASE).alias("char"), F.lit(0).alias("ord"), F.concat(pick(HEADS, i), pick(TAILS, F.floor(i / 20))).alias("reading"))
    second = own.where("id % 7 = 0").select(_letter(i + BASE).alias("char"), F.lit(1).alias("ord"), F.concat(pick(HEADS, i * 3 + 1), pick(TAILS, i + 5)).alias("reading"))
    return first.unionByName(second)


def _people(m) -> DataFrame:
    k = F.col("person_id").cast("long")
    name = F.concat(_letter(k % 90 + BASE), _letter(k * 31 % MANY + BASE), F.when(k % 3 == 0, _letter(k * 17 % 61 + BASE)).otherwise(""))
    return m.persons.select(k.alias("person_id"), name.alias("name"))


def _asked(m) -> DataFrame:
    people = _people(m)
    read = L.readings_of(people, _readings(m), "name").select(F.col("text").alias("name"), F.array_min("full").alias("f"))
    k = F.col("person_id")
    q = F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, F.upper(F.substring("f", 1, 5))).when(k % 4 == 2, F.concat(F.expr("left(name, length(name) - 1)"), _letter(F.lit(BASE + MANY + 7)))).otherwise(_letter(k % 90 + BASE + 240))
    return people.join(read, "name").select(k.alias("id"), q.alias("q"))


@query("jon09_contained_names", """WITH n AS (SELECT DISTINCT name FROM (SELECT split_part(p_name, ' ', 1) AS name FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part UNION ALL SELECT left(text, 12) FROM benchmark UNION ALL SELECT split_part(text, ' ', 3) FROM documents) WHERE name <> '')
SELECT d.doc_id, count(*) AS n, CAST(sum(length(n.name)) AS BIGINT) AS chars, min(n.name) AS first_name FROM documents d JOIN n ON contains(d.text, n.name) GROUP BY 1""")
def jon09(m):
    part = m.table("part")
    docs = m.table("documents")
    names = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).unionByName(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))).unionByName(m.table("benchmark").select(F.substring("text", 1, 12).alias("name"))).unionByName(docs.select(F.split_part("text", F.lit(" "), F.lit(3)).alias("name")))
    # numbered in their own order, so that the first name of a document is a smallest number
    people = cut(numbered(names.where("name <> ''").distinct(), ["name"], 0, "person_id"))
    found = S.containing(docs, "doc_id", "text", people).join(people.select("person_id", F.length("name").alias("chars")), "person_id")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("person_id").alias("person_id"))
    return counts.join(people.select("person_id", F.col("name").alias("first_name")), "person_id").select("doc_id", "n", "chars", "first_name")


@query("res08_match_scores", f"WITH {_VIEWS}, {_ASKED} SELECT id, person_id, CAST(score AS INT) AS score FROM pairs WHERE person_id BETWEEN id - 3 AND id + 90")
def res08(m):
    table, many = _readings(m), m.persons.count() * 94
    # what is looked at of a name is made before it meets its neighbours; these are found by blocks of ids, not by a row for each pair
    block = lambda c: F.floor(c / BLOCK)
    asked = L.legible(_asked(m), "q", table, "query").select("id", "query", F.explode(F.sequence(block(F.col("id") - 3), block(F.col("id") + 90))).alias("block"))
    people = L.legible(_people(m), "name", table, "name").select("person_id", "name", block(F.col("person_id")).alias("block"))
    pairs = spread(asked, many, "block").join(spread(people, many, "block"), "block").where("person_id between id - 3 and id + 90")
    return pairs.select("id", "person_id", L.fit(F.col("query"), F.col("name")).alias("score"))


@query("res10_readings", f"WITH {_VIEWS} SELECT person_id, string_agg(DISTINCT f, '|' ORDER BY f) AS readings, string_agg(DISTINCT i, '|' ORDER BY i) AS initials FROM w GROUP BY 1")
def res10(m):
    people = _people(m)
    read = L.readings_of(people, _readings(m), "name").withColumnRenamed("text", "name")
    text = lambda c: F.array_join(F.array_sort(c), "|")
    return people.join(read, "name").select("person_id", text("full").alias("readings"), text("initials").alias("initials"))


@query("res10_begun", f"WITH {_VIEWS} SELECT DISTINCT p.person_id, p.name FROM p JOIN w USING (person_id) WHERE starts_with(f, 'zha') OR starts_with(i, 'zha')")
def res10_begun(m):
    return L.begun(L.reading_index(_people(m), _readings(m)), " ZhA ")


@query("res12_fuzzy_mentions", f"""WITH {_VIEWS}, {_ASKED},
whole AS (SELECT q.id, p.person_id, row_number() OVER (PARTITION BY q.id ORDER BY length(p.name) DESC, p.person_id) AS k FROM q JOIN p ON contains(q.q, p.name)),
best AS (SELECT id, person_id, row_number() OVER (PARTITION BY id ORDER BY score, person_id) AS k FROM pairs WHERE score IS NOT NULL AND id NOT IN (SELECT id FROM whole))
SELECT id AS question_id, person_id FROM whole WHERE k = 1 UNION ALL SELECT id, person_id FROM best WHERE k = 1""")
def res12(m):
    questions = _asked(m).select(F.col("id").alias("question_id"), F.concat("q", F.lit(ASKING)).alias("question"))
    return S.mentioned(questions, _people(m), readings=_readings(m)).select("question_id", "person_id")


@query("ret15_all_materials", """WITH p AS (SELECT branch_id AS person_id, split_part((SELECT text FROM documents d WHERE d.doc_id = b.branch_id), ' ', 2) AS name FROM v_branches b),
k AS (SELECT person_id, lower(regexp_replace(name, '\\s', '', 'g')) AS key FROM p),
h AS (SELECT k.person_id, e.entry_id, row_number() OVER (PARTITION BY k.person_id ORDER BY e.page_no, e.entry_id) AS r FROM v_entries e JOIN k ON k.key <> '' AND (contains(lower(regexp_replace(e.title, '\\s', '', 'g')), k.key) OR contains(lower(regexp_replace(e.text, '\\s', '', 'g')), k.key)) WHERE e.status = 'active')
SELECT person_id, r, entry_id FROM h WHERE r <= 40""")
def ret15_all(m):
    docs = m.table("documents").select(F.col("doc_id").alias("branch_id"), F.split_part("text", F.lit(" "), F.lit(2)).alias("name"))
    people = m.branches.select("branch_id").join(docs, "branch_id").select(F.col("branch_id").cast("long").alias("person_id"), "name")
    return T.materials_of(m.entries, people).select("person_id", "r", "entry_id")
