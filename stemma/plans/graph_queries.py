"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merge
from ..operators.apply import Graph
from .registry import query

MEMBERS = "SELECT person_id, lineage_id FROM v_belongs_to UNION SELECT i.person_id, b.lineage_id FROM v_in_branch i JOIN v_branches b USING (branch_id)"


def _members(m):
    return G.scope_members(m.belongs_to, m.in_branch, m.branches)


@query("grf01_person_context", """SELECT p.person_id, p.name, l.name AS lineage_name, b.name AS branch_name FROM v_persons p
LEFT JOIN v_belongs_to t ON t.person_id = p.person_id LEFT JOIN v_lineages l ON l.lineage_id = t.lineage_id
LEFT JOIN v_in_branch i ON i.person_id = p.person_id LEFT JOIN v_branches b ON b.branch_id = i.branch_id""")
def grf01(m):
    return G.with_context(m.persons, m.belongs_to, m.in_branch, m.lineages, m.branches).select("person_id", "name", "lineage_name", "branch_name")


@query("grf02_person_page", f"""WITH m AS ({MEMBERS}), f AS (SELECT * FROM v_persons WHERE person_id IN (SELECT person_id FROM m WHERE lineage_id = 2) AND contains(lower(name), '1') AND gender = 'female')
SELECT person_id, name, (SELECT count(*) FROM f) AS total,
 coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM (SELECT DISTINCT dst FROM v_parent_of e WHERE e.src = p.person_id)), '') AS children,
 coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM (SELECT DISTINCT src FROM v_parent_of e WHERE e.dst = p.person_id)), '') AS parents
FROM (SELECT * FROM f ORDER BY name, person_id LIMIT 20 OFFSET 20) p""")
def grf02(m):
    page = G.person_page(m.persons, m.parent_of, _members(m).where("lineage_id = 2"), name="1", gender="female", offset=20, limit=20)
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    return page.select("person_id", "name", "total", text("children"), text("parents"))


@query("grf03_scope_members", MEMBERS)
def grf03(m):
    return _members(m)


@query("grf04_lineage_list", f"""WITH m AS ({MEMBERS}) SELECT l.lineage_id, l.name, l.code,
 (SELECT count(DISTINCT person_id) FROM m WHERE m.lineage_id = l.lineage_id) AS persons,
 (SELECT string_agg(b.name, ',' ORDER BY b.branch_id) FROM v_branches b WHERE b.lineage_id = l.lineage_id) AS branches FROM v_lineages l""")
def grf04(m):
    out = G.lineage_list(m.lineages, m.branches, _members(m))
    return out.select("lineage_id", "name", "code", "persons", F.array_join("branches", ",").alias("branches"))


@query("grf05_code_of_file", """SELECT DISTINCT p_brand AS brand, CASE WHEN regexp_matches(p_brand, '^[A-Za-z]+#?[0-9]+$') THEN upper(replace(p_brand, '#', '')) || '-001-' || CAST(p_size AS VARCHAR) END AS code FROM part""")
def grf05(m):
    name = F.concat(F.lit("scans/"), F.regexp_replace("p_brand", "#", ""), F.lit("-001-"), F.col("p_size").cast("string"), F.lit("-rest.pdf"))
    return m.table("part").select(F.col("p_brand").alias("brand"), G.code_of_file(name).alias("code")).distinct()


@query("grf06_refused_branches", """SELECT lineage_id, name, CASE WHEN lineage_id NOT IN (SELECT lineage_id FROM v_lineages) THEN 'no such lineage' ELSE 'name taken' END AS reason
FROM (SELECT (branch_id % 7) AS lineage_id, name FROM v_branches) n WHERE lineage_id NOT IN (SELECT lineage_id FROM v_lineages) OR EXISTS (SELECT 1 FROM v_branches b WHERE b.lineage_id = n.lineage_id AND b.name = n.name)""")
def grf06(m):
    return G.refused_branches(m.branches.select((F.col("branch_id") % 7).alias("lineage_id"), "name"), m.lineages, m.branches)


@query("grf07_replace_membership", """SELECT person_id, branch_id FROM v_in_branch WHERE person_id % 10 <> 3
UNION ALL SELECT person_id, generation AS branch_id FROM v_persons WHERE person_id % 10 = 3 AND person_id % 20 = 3""")
def grf07(m):
    changes = m.persons.where("person_id % 10 = 3").select("person_id", F.when(F.col("person_id") % 20 == 3, F.col("generation")).cast("int").alias("branch_id"))
    return G.replace_membership(m.in_branch, changes)


@query("grf08_named_edges", """SELECT 'parent_of' AS type, e.src, e.dst, a.name AS from_name, b.name AS to_name FROM v_parent_of e JOIN v_persons a ON a.person_id = e.src JOIN v_persons b ON b.person_id = e.dst
UNION ALL SELECT 'spouse_of', e.src, e.dst, a.name, b.name FROM v_spouse_of e JOIN v_persons a ON a.person_id = e.src JOIN v_persons b ON b.person_id = e.dst""")
def grf08(m):
    return G.named_edges(m.parent_of, m.persons, "parent_of").unionByName(G.named_edges(m.spouse_of, m.persons, "spouse_of"))


@query("grf09_induced_tree", f"""WITH m AS ({MEMBERS}), s AS (SELECT person_id FROM m WHERE lineage_id = 1) SELECT src, dst FROM v_parent_of WHERE src IN (SELECT * FROM s) AND dst IN (SELECT * FROM s)""")
def grf09(m):
    return G.induced_edges(m.parent_of, _members(m).where("lineage_id = 1")).select("src", "dst")


@query("grf10_ego_network", """WITH RECURSIVE e AS (SELECT src, dst FROM v_parent_of UNION SELECT dst, src FROM v_parent_of UNION SELECT src, dst FROM v_spouse_of UNION SELECT dst, src FROM v_spouse_of),
r AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def grf10(m):
    return G.ego_network(m.persons.where("person_id = 5"), m.parent_of, m.spouse_of, 3).select("node", F.col("depth").cast("long").alias("depth"))


@query("grf10_all_networks", """WITH RECURSIVE e AS (SELECT src, dst FROM v_parent_of UNION SELECT dst, src FROM v_parent_of UNION SELECT src, dst FROM v_spouse_of UNION SELECT dst, src FROM v_spouse_of),
r AS (SELECT person_id AS seed, person_id AS node, 0 AS depth FROM v_persons UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY seed, node""")
def grf10_all(m):
    edges = G.both_ways(m.parent_of.select("src", "dst").unionByName(m.spouse_of.select("src", "dst")))
    return G.reach_all(m.persons, edges, 3, symmetric=True).select("seed", "node", F.col("depth").cast("long").alias("depth"))


@query("grf16_all_descendants", """WITH RECURSIVE r AS (SELECT person_id AS seed, person_id AS node, 0 AS depth FROM v_persons UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN v_parent_of e ON e.src = r.node WHERE r.depth < 10)
SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY seed, node HAVING min(depth) > 0""")
def grf16_all(m):
    found = G.reach_all(m.persons, m.parent_of.select("src", "dst").distinct(), 10)
    return found.where("depth > 0").select("seed", "node", F.col("depth").cast("long").alias("depth"))


_UP = "SELECT DISTINCT e.dst AS person_id, e.src AS relative_id FROM v_parent_of e WHERE e.dst IN (SELECT person_id FROM v_persons)"
_SIB = "SELECT DISTINCT a.dst AS person_id, b.dst AS relative_id FROM v_parent_of a JOIN v_parent_of b ON a.src = b.src AND a.dst <> b.dst"
_WED = "SELECT src AS person_id, dst AS relative_id FROM v_spouse_of UNION SELECT dst, src FROM v_spouse_of"
_GRAND = "SELECT DISTINCT a.dst AS person_id, b.src AS relative_id FROM v_parent_of a JOIN v_parent_of b ON b.dst = a.src"
_DOWN = "SELECT DISTINCT src AS person_id, dst AS relative_id FROM v_parent_of"
for _id, _base, _kinds in (("grf11", _UP, ("parents", "father", "mother")), ("grf12", _GRAND, ("grandfather", "grandmother")), ("grf13", _DOWN, ("children", "son", "daughter")), ("grf14", _SIB, ("sibling", "brother", "sister")), ("grf15", _WED, ("spouse", "husband", "wife"))):
    for _kind in _kinds:
        _sex = {"father": "male", "grandfather": "male", "son": "male", "brother": "male", "husband": "male", "mother": "female", "grandmother": "female", "daughter": "female", "sister": "female", "wife": "female"}.get(_kind)
        _sql = f"SELECT x.person_id, x.relative_id FROM ({_base}) x JOIN v_persons p ON p.person_id = x.relative_id JOIN v_persons q ON q.person_id = x.person_id" + (f" WHERE p.gender = '{_sex}'" if _sex else "")
        query(f"{_id}_{_kind}", _sql)(lambda m, kind=_kind: G.relatives(m.parent_of, m.spouse_of, m.persons, kind))


@query("grf16_descendants", """WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN v_parent_of e ON e.src = r.node WHERE r.depth < 10),
g AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node HAVING min(depth) > 0) SELECT node, depth FROM g ORDER BY depth, node LIMIT 100""")
def grf16(m):
    return G.lineal(m.persons.where("person_id = 1"), m.parent_of, down=True).select("node", F.col("depth").cast("long").alias("depth"))


@query("grf16_ancestors", """WITH RECURSIVE r AS (SELECT CAST(77 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN v_parent_of e ON e.dst = r.node WHERE r.depth < 10),
g AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node HAVING min(depth) > 0) SELECT node, depth FROM g ORDER BY depth, node LIMIT 100""")
def grf16_up(m):
    return G.lineal(m.persons.where("person_id = 77"), m.parent_of, down=False).select("node", F.col("depth").cast("long").alias("depth"))


@query("grf17_person_detail", f"""WITH u AS ({_UP}), d AS ({_DOWN}), w AS ({_WED}), k AS (SELECT person_id, birth_year FROM v_persons)
SELECT p.person_id, p.name, (SELECT string_agg(CAST(relative_id AS VARCHAR), ',' ORDER BY relative_id) FROM u JOIN k ON k.person_id = u.relative_id WHERE u.person_id = p.person_id) AS parents,
(SELECT string_agg(CAST(relative_id AS VARCHAR), ',' ORDER BY k.birth_year NULLS LAST, relative_id) FROM d JOIN k ON k.person_id = d.relative_id WHERE d.person_id = p.person_id) AS children,
(SELECT string_agg(CAST(relative_id AS VARCHAR), ',' ORDER BY relative_id) FROM w JOIN k ON k.person_id = w.relative_id WHERE w.person_id = p.person_id) AS spouses FROM v_persons p""")
def grf17(m):
    d = G.person_detail(m.persons, m.parent_of, m.spouse_of)
    return d.select("person_id", "name", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("parents", "children", "spouses")))


@query("grf18_delete_persons", """SELECT src, dst FROM v_parent_of WHERE src % 9 <> 4 AND dst % 9 <> 4""")
def grf18(m):
    return G.delete_nodes(m.persons, {"parent_of": m.parent_of}, m.persons.where("person_id % 9 = 4"))[1]["parent_of"].select("src", "dst")


@query("grf19_delete_scope", """SELECT person_id, name FROM v_persons WHERE person_id NOT IN (SELECT person_id FROM v_in_branch WHERE branch_id = 7)""")
def grf19(m):
    return G.delete_nodes(m.persons, {}, m.in_branch.where("branch_id = 7"))[0].select("person_id", "name")


@query("grf20_delete_lineage", f"""WITH m AS ({MEMBERS}), s AS (SELECT person_id FROM m WHERE lineage_id = 3) SELECT (SELECT count(*) FROM s) AS removed, (SELECT count(*) FROM v_persons WHERE person_id NOT IN (SELECT * FROM s)) AS kept,
(SELECT count(*) FROM v_spouse_of WHERE src NOT IN (SELECT * FROM s) AND dst NOT IN (SELECT * FROM s)) AS edges, (SELECT count(*) FROM v_entries WHERE lineage_id <> 3) AS entries""")
def grf20(m):
    scope = _members(m).where("lineage_id = 3")
    nodes, edges = G.delete_nodes(m.persons, {"spouse_of": m.spouse_of}, scope)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(scope, "removed").crossJoin(count(nodes, "kept")).crossJoin(count(edges["spouse_of"], "edges")).crossJoin(count(m.entries.where("lineage_id <> 3"), "entries"))


@query("grf21_purge_tasks", """WITH t AS (SELECT task_id, CASE WHEN task_id % 11 <> 0 THEN task_id % 400 END AS lineage_id FROM v_tasks), g AS (SELECT task_id FROM t WHERE task_id % 400 < 40 OR task_id % 13 = 0),
c AS (SELECT DISTINCT part_id + 100000 * (task_id % 50) AS person_id, task_id FROM v_pages), e AS (SELECT entry_id, entry_id * 7 AS task_id, entry_id * 7 % 400 AS lineage_id FROM v_entries),
l AS (SELECT DISTINCT lineage_id FROM t WHERE lineage_id IS NOT NULL AND lineage_id % 9 <> 0), m AS (SELECT person_id, person_id % 17 * 23 AS lineage_id FROM c),
p AS (SELECT DISTINCT person_id FROM c WHERE task_id IN (SELECT task_id FROM g) AND person_id NOT IN (SELECT person_id FROM c WHERE task_id NOT IN (SELECT task_id FROM g))),
x AS (SELECT entry_id FROM e WHERE task_id IN (SELECT task_id FROM g)),
z AS (SELECT lineage_id FROM l WHERE lineage_id IN (SELECT lineage_id FROM t WHERE task_id IN (SELECT task_id FROM g)) AND lineage_id NOT IN (SELECT lineage_id FROM t WHERE lineage_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM g)) AND lineage_id NOT IN (SELECT lineage_id FROM e WHERE task_id NOT IN (SELECT task_id FROM g)) AND lineage_id NOT IN (SELECT lineage_id FROM m WHERE person_id NOT IN (SELECT person_id FROM p)))
SELECT 'persons' AS kind, person_id AS id FROM p UNION ALL SELECT 'entries', entry_id FROM x UNION ALL SELECT 'vectors', entry_id FROM v_vectors WHERE entry_id IN (SELECT entry_id FROM x) UNION ALL SELECT 'lineages', lineage_id FROM z UNION ALL SELECT 'branches', lineage_id * 10 + k FROM z, range(2) r(k)""")
def grf21(m):
    from ..operators.maintenance import purged

    t = F.col("task_id")
    tasks = m.tasks.select("task_id", F.when(t % 11 != 0, t % 400).alias("lineage_id"))
    purge = tasks.where("task_id % 400 < 40 or task_id % 13 = 0")
    seen = m.pages.select((F.col("part_id") + 100000 * (t % 50)).alias("person_id"), "task_id").distinct()
    entries = m.entries.select("entry_id", (F.col("entry_id") * 7).alias("task_id"), (F.col("entry_id") * 7 % 400).alias("lineage_id"))
    lineages = tasks.where("lineage_id % 9 <> 0").select("lineage_id").distinct()
    branches = lineages.select("lineage_id", F.explode(F.array(F.col("lineage_id") * 10, F.col("lineage_id") * 10 + 1)).alias("branch_id"))
    members = seen.select("person_id", (F.col("person_id") % 17 * 23).alias("lineage_id"))
    gone = purged(purge, tasks, seen, entries, m.vectors, lineages, branches, members)
    rows = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("long").alias("id")) for kind, df in gone.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


# of fifty people each, a chain (9 into 8 into 7 into 6) and a star (20 to 24 into 19, the last one first)
_MERGED = """g AS (SELECT person_id, CASE WHEN person_id % 4 = 0 THEN '' ELSE name END AS name, CASE WHEN person_id % 5 = 0 THEN NULL WHEN person_id % 3 <> 1 THEN 'unknown' ELSE gender END AS gender, birth_year, CASE WHEN person_id % 2 = 0 THEN generation END AS generation FROM v_persons),
t AS (SELECT person_id, person_id - person_id % 50 + CASE WHEN person_id % 50 < 10 THEN 6 ELSE 19 END AS root, CASE WHEN person_id % 50 < 10 THEN person_id % 50 ELSE 30 - person_id % 50 END AS place, CASE person_id % 50 WHEN 8 THEN n7 WHEN 9 THEN n7 OR n8 ELSE false END AS blocked FROM (SELECT person_id, (SELECT gender IS NULL FROM g x WHERE x.person_id = g.person_id - g.person_id % 50 + 7) AS n7, (SELECT gender IS NULL FROM g x WHERE x.person_id = g.person_id - g.person_id % 50 + 8) AS n8 FROM g) WHERE person_id % 50 BETWEEN 7 AND 9 OR person_id % 50 BETWEEN 20 AND 24),
r AS (SELECT g.*, coalesce(root, g.person_id) AS root, coalesce(place, -1) AS place, coalesce(blocked, false) AS blocked FROM g LEFT JOIN t USING (person_id))"""
_EDGES = """e AS (SELECT 'parent_child' AS type, src, dst, concat('p', CAST(dst AS VARCHAR)) AS rel_id, CASE WHEN dst % 3 = 0 THEN concat('day ', CAST(dst AS VARCHAR)) END AS marriage_date FROM v_parent_of WHERE src <> dst UNION ALL SELECT 'spouse', src, dst, concat('s', CAST(src AS VARCHAR)), CASE WHEN src % 3 = 1 THEN concat('day ', CAST(src AS VARCHAR)) END FROM v_spouse_of)"""


@query("grf22_merge_persons", f"""WITH {_MERGED}, {_EDGES},
m AS (SELECT e.*, coalesce(a.root, src) AS s, coalesce(b.root, dst) AS d, a.root IS NOT NULL OR b.root IS NOT NULL AS moved, type = 'spouse' AND a.root IS NULL AND b.root IS NOT NULL AS turned, coalesce(a.place, b.place) AS place FROM e LEFT JOIN t a ON a.person_id = src LEFT JOIN t b ON b.person_id = dst),
o AS (SELECT type, CASE WHEN turned THEN d ELSE s END AS s, CASE WHEN turned THEN s ELSE d END AS d, rel_id, marriage_date, moved, place, src, dst FROM m WHERE s <> d),
x AS (SELECT *, row_number() OVER w AS r, first_value(marriage_date IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS day FROM o WINDOW w AS (PARTITION BY type, CASE WHEN type = 'spouse' THEN least(s, d) ELSE s END, CASE WHEN type = 'spouse' THEN greatest(s, d) ELSE d END ORDER BY moved, place, rel_id, src, dst))
SELECT type, s AS src, d AS dst, CASE WHEN moved THEN left(sha256(concat_ws('|', type, CAST(s AS VARCHAR), CAST(d AS VARCHAR))), 24) ELSE rel_id END AS rel_id, day AS marriage_date FROM x WHERE r = 1""")
def grf22(m):
    return _merged(m).edges


@query("grf22_merge_attributes", f"""WITH {_MERGED} SELECT root AS person_id, coalesce(first(name ORDER BY place) FILTER (name <> ''), last(name ORDER BY place)) AS name, CASE WHEN max(gender) FILTER (place = -1) = 'unknown' THEN coalesce(first(gender ORDER BY place) FILTER (place >= 0 AND NOT blocked AND gender <> 'unknown'), 'unknown') ELSE max(gender) FILTER (place = -1) END AS gender, first(birth_year ORDER BY place) FILTER (birth_year IS NOT NULL) AS birth_year, first(generation ORDER BY place) FILTER (generation IS NOT NULL) AS generation FROM r GROUP BY root""")
def grf22_attributes(m):
    return _merged(m).persons


@query("grf22_merge_members", f"""WITH {_MERGED} SELECT DISTINCT 'lineage' AS kind, r.root AS person_id, b.lineage_id AS id FROM v_belongs_to b JOIN r USING (person_id) UNION ALL SELECT DISTINCT 'branch', r.root, b.branch_id FROM v_in_branch b JOIN r USING (person_id)""")
def grf22_members(m):
    after = _merged(m)
    rows = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "person_id", F.col(c).alias("id"))
    return rows(after.belongs_to, "lineage", "lineage_id").unionByName(rows(after.in_branch, "branch", "branch_id"))


def _merged(m):
    k, at = F.col("person_id").cast("long"), F.col("person_id") % 50
    gender = F.when(k % 5 == 0, None).when(k % 3 != 1, "unknown").otherwise(F.col("gender"))
    persons = m.persons.select(k.alias("person_id"), F.when(k % 4 == 0, "").otherwise(F.col("name")).alias("name"), gender.alias("gender"), "birth_year", F.when(k % 2 == 0, F.col("generation")).alias("generation"))
    chain = persons.where(at.between(7, 9)).select(k.alias("secondary"), (k - 1).alias("primary"), F.lit(0).alias("ord"))
    star = persons.where(at.between(20, 24)).select(k.alias("secondary"), (k - at + 19).alias("primary"), (-at).cast("int").alias("ord"))
    text = lambda letter, n: F.concat(F.lit(letter), F.col(n).cast("string"))
    parents = m.parent_of.where("src <> dst").select(F.lit("parent_child").alias("type"), "src", "dst", text("p", "dst").alias("rel_id"), F.when(F.col("dst") % 3 == 0, text("day ", "dst")).alias("marriage_date"))
    spouses = m.spouse_of.select(F.lit("spouse").alias("type"), "src", "dst", text("s", "src").alias("rel_id"), F.when(F.col("src") % 3 == 1, text("day ", "src")).alias("marriage_date"))
    none = m.spark.createDataFrame([], "person_id long, doc_id long")
    return merge.merge_people(Graph(persons, parents.unionByName(spouses), m.belongs_to, m.in_branch, none), chain.unionByName(star))


@query("grf23_without_isolated", """SELECT person_id, name FROM v_persons WHERE (person_id IN (SELECT src FROM v_spouse_of UNION SELECT dst FROM v_spouse_of) AND name NOT IN ('Customer#000000001', 'Customer#1')) OR person_id = 3""")
def grf23(m):
    return G.without_isolated(m.persons.select("person_id", "name"), m.spouse_of, ["Customer#000000001", "Customer#1"], focus=3)


@query("grf24_branch_rollup", """SELECT coalesce(b.name, 'unassigned') AS branch, count(*) AS n FROM v_persons p LEFT JOIN v_in_branch i USING (person_id) LEFT JOIN v_branches b ON b.branch_id = i.branch_id GROUP BY 1""")
def grf24(m):
    return G.rolled_up(m.persons, m.in_branch, m.branches)


@query("grf25_degrees", """SELECT p.person_id, (SELECT count(*) FROM v_parent_of WHERE src = p.person_id) + (SELECT count(*) FROM v_parent_of WHERE dst = p.person_id) AS degree FROM v_persons p""")
def grf25(m):
    return G.degrees(m.persons, m.parent_of)
