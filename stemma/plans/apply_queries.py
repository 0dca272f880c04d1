"""Queries that apply reviewed tasks to the graph, all tasks of a table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply as A
from .cut import cut
from .registry import query

#: The graph: people of few names, in an order of age that is not that of their ids; reviewed rows: a person and a relation for each page.
_VIEWS = """g AS (SELECT person_id, name, CASE WHEN person_id % 3 = 0 THEN 'male' END AS gender, CASE WHEN person_id % 10 = 0 THEN NULL ELSE (person_id * 7919) % 997 END AS created_at, CASE WHEN person_id % 2 = 0 THEN birth_year END AS birth_year, CAST(NULL AS BIGINT) AS death_year, CASE WHEN person_id % 5 = 0 THEN 'there' END AS birth_place, CAST(NULL AS VARCHAR) AS biography FROM v_dup_persons),
ge AS (SELECT CASE WHEN person_id % 2 = 0 THEN 'spouse' ELSE 'parent_child' END AS type, person_id AS src, person_id + 1 AS dst, CASE WHEN person_id % 4 < 2 THEN concat('r', CAST(person_id AS VARCHAR)) END AS rel_id, 'old' AS marriage_date FROM g WHERE person_id % 3 = 0 AND person_id + 1 IN (SELECT person_id FROM g)),
t AS (SELECT DISTINCT task_id, CASE WHEN task_id % 3 <> 0 THEN task_id % 7 END AS lineage_id, task_id % 25 AS branch_id, CASE WHEN task_id % 4 = 0 THEN task_id % 11 END AS doc_id FROM v_pages),
pe AS (SELECT task_id, page_no AS place, CASE v.part_id % 4 WHEN 0 THEN concat(' New ', CAST(v.part_id % 50 AS VARCHAR)) WHEN 1 THEN upper(d.name) ELSE replace(d.name, ' ', '') END AS name, CASE v.person_id % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'x' END AS gender, CASE WHEN v.part_id % 3 = 0 THEN 1800 + page_no END AS birth_year, CASE WHEN v.part_id % 5 = 0 THEN 1900 + page_no END AS death_year, CASE WHEN v.part_id % 7 = 0 THEN concat('place ', CAST(task_id AS VARCHAR)) END AS birth_place, CASE WHEN v.part_id % 11 = 0 THEN concat('life ', CAST(task_id AS VARCHAR)) END AS biography, CASE WHEN page_no % 5 = 4 THEN false WHEN page_no % 5 = 2 THEN true END AS confirmed FROM v_pages v JOIN v_dup_persons d ON d.person_id = v.part_id),
re AS (SELECT task_id, place, CASE place % 4 WHEN 0 THEN 'spouse' WHEN 3 THEN 'cousin' ELSE ' parent_child' END AS type, name AS from_name, CASE WHEN place % 6 = 5 THEN '  ' WHEN task_id % 2 = 0 THEN concat('Other ', CAST(task_id % 40 AS VARCHAR)) ELSE coalesce(lag(name) OVER (PARTITION BY task_id ORDER BY place), name) END AS to_name, CASE WHEN place % 2 = 0 THEN concat('day ', CAST(task_id AS VARCHAR)) END AS marriage_date, CASE WHEN place % 7 = 6 THEN false END AS confirmed FROM pe),
"""
_SQL = _VIEWS + """said AS (SELECT task_id, 0 AS kind, place, 0 AS side, trim(name) AS name, CASE WHEN gender IN ('male', 'female') THEN gender ELSE 'unknown' END AS gender, birth_year, death_year, birth_place, biography FROM pe WHERE coalesce(confirmed, true)),
good AS (SELECT task_id, place, trim(type) AS type, trim(from_name) AS f, trim(to_name) AS o, marriage_date FROM re WHERE coalesce(confirmed, true) AND trim(type) IN ('spouse', 'parent_child') AND trim(from_name) <> '' AND trim(to_name) <> ''),
men AS (SELECT *, lower(replace(name, ' ', '')) AS k FROM (SELECT * FROM said UNION ALL SELECT task_id, 1, place, 0, f, 'unknown', NULL, NULL, NULL, NULL FROM good UNION ALL SELECT task_id, 1, place, 1, o, 'unknown', NULL, NULL, NULL, NULL FROM good)),
lead AS (SELECT k, first(name ORDER BY task_id, kind, place, side) AS name, first(gender ORDER BY task_id, kind, place, side) AS gender, first(birth_year ORDER BY task_id, kind, place, side) FILTER (birth_year IS NOT NULL) AS birth_year, first(death_year ORDER BY task_id, kind, place, side) FILTER (death_year IS NOT NULL) AS death_year, first(birth_place ORDER BY task_id, kind, place, side) FILTER (birth_place IS NOT NULL) AS birth_place, first(biography ORDER BY task_id, kind, place, side) FILTER (biography IS NOT NULL) AS biography FROM men GROUP BY 1),
old AS (SELECT k, person_id FROM (SELECT lower(replace(name, ' ', '')) AS k, person_id, row_number() OVER (PARTITION BY lower(replace(name, ' ', '')) ORDER BY created_at NULLS LAST, person_id) AS r FROM g) WHERE r = 1),
fresh AS (SELECT k, (SELECT max(person_id) FROM g) + row_number() OVER (ORDER BY k) AS person_id FROM lead WHERE k NOT IN (SELECT k FROM old)),
who AS (SELECT k, person_id FROM old WHERE k IN (SELECT k FROM lead) UNION ALL SELECT k, person_id FROM fresh),
map AS (SELECT DISTINCT task_id, name, person_id FROM men JOIN who USING (k)),
put AS (SELECT person_id, lineage_id, branch_id FROM (SELECT m.person_id, t.*, row_number() OVER (PARTITION BY m.person_id ORDER BY t.task_id DESC) AS r FROM (SELECT DISTINCT task_id, person_id FROM map) m JOIN t ON t.task_id = m.task_id AND t.lineage_id IS NOT NULL) WHERE r = 1)
"""


def _views(m):
    text = _VIEWS.replace("VARCHAR", "STRING")
    frames = {f"v_{n}": getattr(m, n) for n in ("dup_persons", "pages", "branches", "lineages")}
    for n in frames:
        text = text.replace(f" {n} ", f" {{{n}}} ").replace(f" {n})", f" {{{n}}})").replace(f" {n},", f" {{{n}}},")
    used = {k: v for k, v in frames.items() if f"{{{k}}}" in text}
    read = lambda name: m.spark.sql(f"WITH {text.strip().rstrip(',')} SELECT * FROM {name}", **used)
    none = lambda ddl: m.spark.createDataFrame([], ddl)
    graph = A.Graph(read("g"), read("ge"), m.belongs_to.selectExpr("cast(person_id as bigint) as person_id", "cast(lineage_id as bigint) as lineage_id"), m.in_branch.selectExpr("cast(person_id as bigint) as person_id", "cast(branch_id as bigint) as branch_id"), none("person_id long, doc_id long"))
    long = lambda df, *cs: df.withColumns({c: F.col(c).cast("long") for c in cs})
    people = cut(read("pe"))  # relations are made of people: pages are numbered and named once
    relations = m.spark.sql(text.rpartition("re AS (")[2].strip().rstrip(",").removesuffix(")").replace(" FROM pe", " FROM {pe}"), pe=people)
    return A.Applied(graph, long(read("t"), "lineage_id", "branch_id", "doc_id"), people, relations, long(m.lineages, "lineage_id"), long(m.branches, "lineage_id", "branch_id"))


@query("res14_people", f"""WITH {_SQL} SELECT g.person_id, g.name, g.gender, coalesce(g.birth_year, l.birth_year) AS birth_year, l.death_year, coalesce(g.birth_place, l.birth_place) AS birth_place, l.biography FROM g LEFT JOIN old ON old.person_id = g.person_id LEFT JOIN lead l ON l.k = old.k
UNION ALL SELECT f.person_id, l.name, l.gender, l.birth_year, l.death_year, l.birth_place, l.biography FROM fresh f JOIN lead l USING (k)""")
def res14_people(m):
    return _views(m).persons.select("person_id", "name", "gender", "birth_year", "death_year", "birth_place", "biography")


@query("res14_applied_relations", f"""WITH {_SQL}, tie AS (SELECT type, a.person_id AS src, b.person_id AS dst, last(marriage_date ORDER BY task_id, place) AS marriage_date FROM good JOIN who a ON a.k = lower(replace(f, ' ', '')) JOIN who b ON b.k = lower(replace(o, ' ', '')) GROUP BY 1, 2, 3)
SELECT coalesce(n.type, e.type) AS type, coalesce(n.src, e.src) AS src, coalesce(n.dst, e.dst) AS dst, CASE WHEN n.type IS NULL THEN e.rel_id ELSE coalesce(e.rel_id, left(sha256(concat_ws('|', n.type, CAST(n.src AS VARCHAR), CAST(n.dst AS VARCHAR))), 24)) END AS rel_id, CASE WHEN n.type IS NULL THEN e.marriage_date ELSE n.marriage_date END AS marriage_date FROM tie n FULL JOIN ge e ON e.type = n.type AND e.src = n.src AND e.dst = n.dst""")
def res14_relations(m):
    return _views(m).edges


@query("res14_counters", f"""WITH {_SQL} SELECT t.task_id, (SELECT count(DISTINCT person_id) FROM map WHERE map.task_id = t.task_id) AS created_persons, coalesce(s.n, 0) AS linked_persons, coalesce(r.made, 0) AS created_relations, coalesce(r.skipped, 0) AS skipped FROM t
LEFT JOIN (SELECT task_id, count(*) - count(DISTINCT person_id) AS n FROM said JOIN who ON who.k = lower(replace(said.name, ' ', '')) GROUP BY 1) s ON s.task_id = t.task_id
LEFT JOIN (SELECT task_id, count(*) FILTER (trim(type) IN ('spouse', 'parent_child') AND trim(from_name) <> '' AND trim(to_name) <> '') AS made, count(*) FILTER (NOT (trim(type) IN ('spouse', 'parent_child') AND trim(from_name) <> '' AND trim(to_name) <> '')) AS skipped FROM re WHERE coalesce(confirmed, true) GROUP BY 1) r ON r.task_id = t.task_id""")
def res14_counters(m):
    return _views(m).counters


@query("res14_memberships", f"""WITH {_SQL} SELECT 'lineage' AS kind, person_id, lineage_id AS id FROM v_belongs_to WHERE person_id NOT IN (SELECT person_id FROM put) UNION ALL SELECT 'lineage', person_id, lineage_id FROM put WHERE lineage_id IN (SELECT lineage_id FROM v_lineages)
UNION ALL SELECT 'branch', person_id, branch_id FROM v_in_branch WHERE person_id NOT IN (SELECT person_id FROM put) UNION ALL SELECT 'branch', person_id, put.branch_id FROM put JOIN v_branches b ON b.branch_id = put.branch_id AND b.lineage_id = put.lineage_id
UNION ALL SELECT DISTINCT 'document', person_id, doc_id FROM map JOIN t ON t.task_id = map.task_id AND doc_id IS NOT NULL""")
def res14_memberships(m):
    after = _views(m)
    rows = [df.select(F.lit(kind).alias("kind"), "person_id", F.col(c).alias("id")) for kind, df, c in (("lineage", after.belongs_to, "lineage_id"), ("branch", after.in_branch, "branch_id"), ("document", after.has_document, "doc_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
