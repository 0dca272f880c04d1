"""Queries of single rules: their SQL states each rule anew, on names and notes made from ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import maintenance as M
from ..operators import records as R
from ..operators import resolve as S
from ..operators import retrieve as T
from ..sources import files
from .registry import query

NAMES = ["董", "生", "王", "兼德", "承志遠", "初四", "壬寅", "甲四", "葬坐向", "李國藩吳氏", "張三豐", "□", "分金", "吳氏"]
BIOS = ["", "適本地", "十□", "三十", "兼祧之後又承", "長子", "字子明"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query("nrm02_json_repair", """SELECT id, CASE id % 6 WHEN 5 THEN NULL ELSE concat('{"a": ', CAST(id AS VARCHAR), ', "b": "', action, '"}') END AS clean FROM v_audit""")
def nrm02(m):
    a, b = F.col("id").cast("string"), F.col("action")
    raw = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit('so: {"a": '), a, F.lit(', "b": "'), b, F.lit('"} done')))
        .when(F.col("id") % 6 == 1, F.concat(F.lit('{"a": '), a, F.lit(' "b": "'), b, F.lit('"}')))
        .when(F.col("id") % 6 == 2, F.concat(F.lit('{"a": '), a, F.lit(', "b": "'), b, F.lit('",}')))
        .when(F.col("id") % 6 == 3, F.concat(F.lit("{'a': "), a, F.lit(", 'b': '"), b, F.lit("'}")))
        .when(F.col("id") % 6 == 4, F.concat(F.lit('{"a": '), a, F.lit(',, "b": "'), b, F.lit('",,}')))
        .otherwise(F.concat(F.lit('{"a": '), a))
    )
    out = R.parsed(m.audit.withColumn("raw", raw), "raw", "a long, b string", "o")
    return out.select("id", F.when(F.col("o").isNotNull() & F.col("o.a").isNotNull(), F.concat(F.lit('{"a": '), F.col("o.a").cast("string"), F.lit(', "b": "'), F.col("o.b"), F.lit('"}'))).alias("clean"))


@query("nrm07_fragments", f"""WITH p AS (SELECT id, {_sql_list(NAMES)}[CAST(id % {len(NAMES)} + 1 AS BIGINT)] AS name, {_sql_list(BIOS)}[CAST(user_id % {len(BIOS)} + 1 AS BIGINT)] AS bio, [0.4, 0.5, 0.6, 0.7][CAST((id + user_id) % 4 + 1 AS BIGINT)] AS conf FROM v_audit)
SELECT id, name, CASE WHEN conf > 0.6 THEN false
WHEN length(name) = 1 THEN contains('生卒殁歿配適葬墳妣氏長次男女子年月日時坐向分金兼立', name) OR (bio <> '' AND regexp_full_match(bio, '[一二三四五六七八九十廿卅初零□]+')) OR (name = '董' AND (contains(bio, '適') OR contains(bio, '配') OR contains(bio, '宅')))
WHEN conf <= 0.5 AND (name LIKE '兼%' OR name LIKE '承%') AND length(bio) < 4 THEN true
WHEN length(name) = 2 THEN regexp_full_match(name, '[一二三四五六七八九十廿卅初零]+') OR regexp_full_match(name, '[甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥]+')
WHEN conf <= 0.5 THEN contains('生卒殁歿配適娶葬墳妣坐向分金', left(name, 1)) OR (length(name) >= 4 AND contains(name, '氏'))
ELSE false END AS fragment FROM p""")
def nrm07(m):
    conf = F.element_at(F.array(*map(F.lit, (0.4, 0.5, 0.6, 0.7))), ((F.col("id") + F.col("user_id")) % 4 + 1).cast("int"))
    p = m.audit.select("id", _pick(NAMES, F.col("id")).alias("name"), F.nullif(_pick(BIOS, F.col("user_id")), F.lit("")).alias("biography"), conf.alias("confidence"))
    return p.select("id", "name", R.fragment(F.col("name"), F.col("biography"), F.col("confidence")).alias("fragment"))


@query("nrm07_without_fragments", f"""SELECT user_id, count_if(NOT (length({_sql_list(NAMES)}[CAST(id % {len(NAMES)} + 1 AS BIGINT)]) = 2 AND {_sql_list(NAMES)}[CAST(id % {len(NAMES)} + 1 AS BIGINT)] IN ('初四', '壬寅')) AND {_sql_list(NAMES)}[CAST(id % {len(NAMES)} + 1 AS BIGINT)] NOT IN ('生')) AS n FROM v_audit GROUP BY 1""")
def nrm07_kept(m):
    none = F.lit(None)
    p = F.struct(_pick(NAMES, F.col("id")).alias("name"), none.cast("string").alias("biography"), F.lit(0.6).alias("confidence"))
    rows = m.audit.groupBy("user_id").agg(F.collect_list(p).alias("p"))
    return rows.select("user_id", F.size(R.without_fragments(F.col("p"))).cast("long").alias("n"))


@query("nrm09_notes", """WITH d AS (SELECT user_id, name, min(id) AS first FROM (SELECT user_id, id, concat('n', CAST(id % 9 AS VARCHAR)) AS name FROM v_audit WHERE user_id % 5 <> 4) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS r FROM d),
f AS (SELECT user_id, concat('残句照录：', string_agg(name, '；' ORDER BY first)) AS mark FROM r WHERE r <= 6 GROUP BY 1),
u AS (SELECT DISTINCT v.user_id, mark, CASE v.user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' seen ' WHEN 2 THEN 'x 疑为补位' ELSE concat('y', coalesce(mark, '')) END AS old FROM v_audit v LEFT JOIN f ON f.user_id = v.user_id),
m AS (SELECT user_id, coalesce(old, '') AS old, list_filter([CASE WHEN user_id % 3 = 0 THEN '疑为补位' END, mark], lambda x: x IS NOT NULL AND NOT contains(coalesce(old, ''), x)) AS marks FROM u)
SELECT user_id, CASE WHEN len(marks) = 0 THEN old ELSE concat(old, CASE WHEN old <> '' THEN '；' ELSE '' END, array_to_string(marks, '；')) END AS notes FROM m""")
def nrm09(m):
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("user_id") % 5 != 4, F.col("id")))), lambda i: F.concat(F.lit("n"), (i % 9).cast("string")))
    rows = m.audit.groupBy("user_id").agg(names.alias("names"))
    user = F.col("user_id")
    mark = F.concat(F.lit(R.VERBATIM), F.array_join(F.slice(F.array_distinct("names"), 1, 6), "；"))
    old = F.when(user % 4 == 0, None).when(user % 4 == 1, " seen ").when(user % 4 == 2, "x " + R.FILLED_IN).otherwise(F.concat(F.lit("y"), F.when(F.size("names") > 0, mark).otherwise("")))
    return rows.select("user_id", R.noted(old, F.col("names"), user % 3 == 0).alias("notes"))


@query("geo02_columns_in_band", """WITH i AS (SELECT l_orderkey % 500 AS band, l_partkey % 400 AS x, max(l_tax * 2) AS cover FROM lineitem GROUP BY 1, 2 HAVING max(l_tax * 2) > 0.10), g AS (SELECT *, sum(CASE WHEN x - b > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY band ORDER BY x) AS part FROM (SELECT *, lag(x) OVER (PARTITION BY band ORDER BY x) AS b FROM i))
SELECT band, min(x) AS begin, max(x) + 1 AS "end" FROM g GROUP BY band, part HAVING max(x) + 1 - min(x) >= 20""")
def geo02(m):
    profile = m.table("lineitem").groupBy((F.col("l_orderkey") % 500).alias("band"), (F.col("l_partkey") % 400).alias("x")).agg(F.max(F.col("l_tax") * 2).alias("cover"))
    return R.columns_in_band(profile, ["band"], "x", "cover", 1000)


@query("geo04_cells", """WITH c AS (SELECT task_id, sum(part_id % 90 + 20) OVER w - (part_id % 90 + 20) AS begin, sum(part_id % 90 + 20) OVER w - (part_id % 90 + 20) + 15 AS "end", page_no FROM v_pages WINDOW w AS (PARTITION BY task_id ORDER BY page_no)),
g AS (SELECT *, begin - lag("end") OVER (PARTITION BY task_id ORDER BY begin) AS gap FROM c), l AS (SELECT task_id, greatest(list_sort(list(gap))[CAST(floor(count(gap) / 2) + 1 AS BIGINT)] * 2.6, 45.0) AS lim FROM g WHERE gap IS NOT NULL GROUP BY 1),
p AS (SELECT g.*, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY g.task_id ORDER BY begin) AS part FROM g LEFT JOIN l ON l.task_id = g.task_id) SELECT task_id, CAST(min(begin) AS BIGINT) AS begin, CAST(max("end") AS BIGINT) AS "end" FROM p GROUP BY task_id, part""")
def geo04(m):
    from pyspark.sql import Window as W

    wide = F.col("part_id") % 90 + 20
    begin = F.sum(wide).over(W.partitionBy("task_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)) - wide
    columns = m.pages.select("task_id", begin.alias("begin"), (begin + 15).alias("end"))
    return R.grouped_columns(columns, ["task_id"], 1000.0)


_QUALITY = """CASE WHEN count(*) < 3 OR avg(part_id) <= 0 THEN 0.0 ELSE round(0.5 * greatest(0.0, 1 - stddev_pop(part_id) / avg(part_id)) + 0.2 * CASE WHEN count(*) BETWEEN 5 AND 25 THEN 1.0 WHEN count(*) BETWEEN 3 AND 40 THEN 0.5 ELSE 0.2 END + 0.3 * least(1.0, sum(part_id) / 5000.0 * 1.2), 3) END"""


@query("geo06_quality", f"SELECT task_id, {_QUALITY} AS quality FROM v_pages GROUP BY 1")
def geo06(m):
    return R.column_quality(m.pages.withColumn("page", F.lit(5000.0)), ["task_id"], "part_id", "page")


KINDS = ["世系頁 世系表", "序文正文", "功德名錄", "名册", "登記表", "其他", ""]


@query("geo07_layout", f"""WITH q AS (SELECT task_id, {_QUALITY} AS quality, count(*) AS n, {_sql_list(KINDS)}[CAST(task_id % 7 + 1 AS BIGINT)] AS notes FROM v_pages GROUP BY 1)
SELECT task_id, CASE WHEN contains(notes, '世系') THEN 'whole' WHEN contains(notes, '正文') OR contains(notes, '功德') OR contains(notes, '名册') OR contains(notes, '表') THEN 'col_grid' WHEN n >= 3 AND quality >= 0.6 THEN 'col_grid' ELSE 'whole' END AS layout FROM q""")
def geo07(m):
    pages = m.pages.withColumn("page", F.lit(5000.0))
    found = R.column_quality(pages, ["task_id"], "part_id", "page").join(pages.groupBy("task_id").agg(F.count("*").alias("n")), "task_id")
    return found.select("task_id", R.layout(_pick(KINDS, F.col("task_id")), F.col("n"), F.col("quality")).alias("layout"))


@query("geo07_grid_pages", "SELECT task_id, page_no, page_no >= 4 AND task_id % 6 >= 3 AND part_id % 20 BETWEEN 4 AND 16 AS grid FROM v_pages")
def geo07_grid(m):
    return m.pages.select("task_id", F.col("page_no").cast("long").alias("page_no"), R.grid_page(F.col("page_no"), F.col("task_id") % 6, F.col("part_id") % 20).alias("grid"))


@query("con03_block_results", """SELECT task_id, page_no, 'person' AS kind, concat('P', CAST(person_id AS VARCHAR)) AS name, CASE person_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'unknown' ELSE 'female' END AS what, CASE WHEN page_no % 3 = 0 THEN 0.5 ELSE least(1.0, round(confidence * 2, 2)) END AS confidence FROM v_pages WHERE person_id % 5 <> 0
UNION ALL SELECT task_id, page_no, 'relation', concat('P', CAST(person_id AS VARCHAR)), CASE part_id % 3 WHEN 0 THEN 'spouse' ELSE 'parent_child' END, CASE WHEN page_no % 3 = 0 THEN 0.5 ELSE least(1.0, round(confidence * 2, 2)) END FROM v_pages WHERE part_id % 3 < 2 AND person_id % 4 <> 0""")
def con03(m):
    name = F.concat(F.lit("P"), F.col("person_id").cast("string"))
    conf = F.when(F.col("page_no") % 3 != 0, F.col("confidence") * 2)
    none = F.lit(None)
    person = F.struct(F.when(F.col("person_id") % 5 != 0, F.concat(F.lit(" "), name, F.lit("\n"))).otherwise("  ").alias("name"), F.when(F.col("person_id") % 3 == 0, "MALE").when(F.col("person_id") % 3 == 2, "Female").alias("gender"), none.cast("int").alias("birth_year"), none.cast("int").alias("death_year"), none.cast("string").alias("birth_place"), none.cast("string").alias("biography"), conf.alias("confidence"))
    relation = F.struct(F.when(F.col("part_id") % 3 == 0, " spouse ").when(F.col("part_id") % 3 == 1, "parent_child").otherwise("cousin").alias("type"), name.alias("from_name"), F.when(F.col("person_id") % 4 != 0, "x").alias("to_name"), conf.alias("confidence"))
    page = F.col("page_no").cast("long")
    out = m.pages.select("task_id", page.alias("page_no"), R.block_results(F.array(person), F.array(relation), F.array(page)).alias("r"))
    one = lambda kind, name, what, p: F.struct(F.lit(kind).alias("kind"), p[name].alias("name"), p[what].alias("what"), p["confidence"].alias("confidence"))
    both = F.concat(F.transform("r.persons", lambda p: one("person", "name", "gender", p)), F.transform("r.relations", lambda p: one("relation", "from_name", "type", p)))
    return out.select("task_id", "page_no", F.explode(both).alias("p")).select("task_id", "page_no", "p.*")  # pages are read once


_BRIEFS = """b AS (SELECT person_id % 5 AS task_id, row_number() OVER (PARTITION BY person_id % 5 ORDER BY person_id) - 1 AS number, p.* FROM v_persons p),
l AS (SELECT task_id, number, concat(CAST(number AS VARCHAR), '|', name, '|', CASE gender WHEN 'male' THEN '男' WHEN 'female' THEN '女' ELSE '' END, '|', coalesce(CAST(birth_year AS VARCHAR), ''), CASE WHEN person_id % 3 = 0 THEN '' ELSE concat(CASE WHEN birth_year IS NULL THEN '' ELSE '~' END, CAST(1900 + person_id % 50 AS VARCHAR)) END, '|', substring(birth_place, 1, 16), '|', CASE WHEN person_id % 4 = 0 THEN '' ELSE concat('页', CAST(person_id % 4 AS VARCHAR)) END, '|', repeat('b', 40)) AS brief FROM b)"""


def _briefs(m):
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(F.col("person_id") % 5).orderBy("person_id")) - 1
    pages = F.when(F.col("person_id") % 4 == 0, F.array().cast("array<long>")).otherwise(F.array((F.col("person_id") % 4).cast("long"), F.lit(9).cast("long")))
    p = F.struct("name", "gender", "birth_year", F.when(F.col("person_id") % 3 != 0, 1900 + F.col("person_id") % 50).alias("death_year"), "birth_place", pages.alias("pages"), F.concat(F.repeat(F.lit("b"), F.lit(30)), F.lit("\n"), F.repeat(F.lit("b"), F.lit(30))).alias("biography"))
    return m.persons.select((F.col("person_id") % 5).alias("task_id"), number.cast("long").alias("number"), p.alias("p")).select("task_id", "number", S.person_brief(F.col("number"), F.col("p")).alias("brief"))


@query("con05_batches", f"""WITH RECURSIVE {_BRIEFS}, r AS (SELECT *, number + 1 AS r FROM l WHERE task_id IN (SELECT task_id FROM l GROUP BY 1 HAVING count(*) >= 200)),
f AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS r, '' AS brief, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS size FROM r UNION ALL SELECT r.task_id, r.r, r.brief, CASE WHEN size > 0 AND size + length(r.brief) > 6000 THEN batch + 1 ELSE batch END, CASE WHEN size > 0 AND size + length(r.brief) > 6000 THEN length(r.brief) ELSE size + length(r.brief) END FROM f JOIN r ON r.task_id = f.task_id AND r.r = f.r + 1)
SELECT task_id, r - 1 AS number, brief, batch FROM f WHERE r > 0""")
def con05(m):
    return S.disambiguation_batches(_briefs(m)).withColumn("batch", F.col("batch").cast("long"))


@query("con05_verdicts", """WITH c AS (SELECT person_id % 5 AS task_id, count(*) AS n FROM v_persons GROUP BY 1), v AS (SELECT id, id % 6 AS task_id, user_id % 400 - 5 AS duplicate_index, id % 350 AS keep_index, 0.8 + id % 5 / 20.0 AS confidence FROM v_audit)
SELECT id, duplicate_index, keep_index, round(least(1.0, confidence), 2) AS confidence FROM v JOIN c USING (task_id) WHERE confidence >= 0.9 AND duplicate_index <> keep_index AND duplicate_index >= 0 AND keep_index >= 0 AND duplicate_index < n AND keep_index < n""")
def con05_verdicts(m):
    counts = m.persons.groupBy((F.col("person_id") % 5).alias("task_id")).agg(F.count("*").alias("n"))
    v = m.audit.select("id", (F.col("id") % 6).alias("task_id"), (F.col("user_id") % 400 - 5).alias("duplicate_index"), (F.col("id") % 350).alias("keep_index"), (F.lit(0.8) + F.col("id") % 5 / 20.0).alias("confidence"))
    return S.sure_verdicts(v, counts).select("id", "duplicate_index", "keep_index", "confidence")


@query("qa02_dispatched", """WITH q AS (SELECT person_id, ['father', 'mother', 'parents', 'grandfather', 'grandmother', 'son', 'daughter', 'children', 'brother', 'sister', 'sibling', 'spouse', 'husband', 'wife', 'birthplace', 'lifetime', 'biography', 'generation', 'none'][CAST(person_id % 19 + 1 AS BIGINT)] AS intent FROM v_persons),
e AS (SELECT DISTINCT src, dst FROM v_parent_of), s AS (SELECT src, dst FROM v_spouse_of UNION SELECT dst, src FROM v_spouse_of),
r AS (SELECT dst AS a, src AS b, 'up' AS k FROM e UNION ALL SELECT src, dst, 'down' FROM e UNION SELECT x.dst, y.src, 'upup' FROM e x JOIN e y ON y.dst = x.src UNION SELECT x.dst, y.dst, 'side' FROM e x JOIN e y ON y.src = x.src AND y.dst <> x.dst UNION ALL SELECT src, dst, 'spouse' FROM s)
SELECT q.person_id, intent, r.b AS relative_id, NULL AS answer FROM q JOIN r ON r.a = q.person_id JOIN v_persons p ON p.person_id = r.b
WHERE k = CASE WHEN intent IN ('father', 'mother', 'parents') THEN 'up' WHEN intent LIKE 'grand%' THEN 'upup' WHEN intent IN ('son', 'daughter', 'children') THEN 'down' WHEN intent IN ('brother', 'sister', 'sibling') THEN 'side' WHEN intent IN ('spouse', 'husband', 'wife') THEN 'spouse' END
AND CASE WHEN intent IN ('mother', 'grandmother', 'daughter', 'sister', 'wife') THEN p.gender = 'female' WHEN intent IN ('grandfather', 'son', 'brother', 'husband') THEN p.gender = 'male' ELSE true END
UNION ALL SELECT * FROM (SELECT q.person_id, intent, NULL, CASE intent WHEN 'birthplace' THEN birth_place WHEN 'lifetime' THEN CASE WHEN birth_year IS NOT NULL THEN concat(CAST(birth_year AS VARCHAR), ' 年 — ? 年') END WHEN 'biography' THEN concat('bio of ', name) WHEN 'generation' THEN concat('第 ', CAST(generation AS VARCHAR), ' 代') END AS answer FROM q JOIN v_persons USING (person_id) WHERE intent IN ('birthplace', 'lifetime', 'biography', 'generation')) WHERE answer IS NOT NULL""")
def qa02(m):
    kinds = ["father", "mother", "parents", "grandfather", "grandmother", "son", "daughter", "children", "brother", "sister", "sibling", "spouse", "husband", "wife", "birthplace", "lifetime", "biography", "generation", "none"]
    asked = m.persons.select(F.col("person_id").alias("question_id"), "person_id", _pick(kinds, F.col("person_id")).alias("intent"))
    persons = m.persons.withColumn("death_year", F.lit(None).cast("int")).withColumn("biography", F.concat(F.lit("bio of "), "name"))
    return T.dispatched(asked, persons, m.parent_of, m.spouse_of).select("person_id", "intent", "relative_id", "answer")


@query("qa02_lineal", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM v_parent_of), q AS (SELECT person_id AS seed, CASE WHEN person_id % 2 = 0 THEN 'ancestor' ELSE 'descendant' END AS intent FROM v_persons WHERE person_id % 20 = 0 OR person_id % 20 = 7),
w AS (SELECT seed, intent, seed AS node, 0 AS d FROM q UNION SELECT seed, intent, CASE intent WHEN 'ancestor' THEN src ELSE dst END, d + 1 FROM w JOIN e ON CASE intent WHEN 'ancestor' THEN dst ELSE src END = node WHERE d < 10),
n AS (SELECT seed, intent, node, min(d) AS d FROM w WHERE d > 0 AND node <> seed GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed, intent ORDER BY d, node) AS r FROM n) SELECT seed AS person_id, intent, node AS relative_id FROM r WHERE r <= 100""")
def qa02_lineal(m):
    asked = m.persons.where("person_id % 20 in (0, 7)").select(F.col("person_id").alias("question_id"), "person_id", F.when(F.col("person_id") % 2 == 0, "ancestor").otherwise("descendant").alias("intent"))
    persons = m.persons.withColumn("death_year", F.lit(None).cast("int")).withColumn("biography", F.lit(None).cast("string"))
    return T.dispatched(asked, persons, m.parent_of, m.spouse_of).select("person_id", "intent", "relative_id")


@query("ret05_rebuilt", "SELECT entry_id, length(title) + 1 + least(1200, length(text)) AS width FROM v_entries WHERE status = 'active'")
def ret05(m):
    embed = lambda df: df.select("entry_id", F.array(F.length("input").cast("double")).alias("vector"))
    e, v = m.entries.withColumn("updated_at", F.lit(1)), m.vectors.withColumn("updated_at", F.lit(2))
    fresh, _ = T.rebuilt(e, v, embed)
    return fresh.select("entry_id", F.col("vector")[0].cast("long").alias("width"))


@query("ret05_rebuilt_counts", "SELECT (SELECT count(*) FROM v_entries WHERE status = 'active') AS synced, (SELECT count(*) FROM v_vectors) AS deleted")
def ret05_counts(m):
    return T.rebuilt(m.entries.withColumn("updated_at", F.lit(1)), m.vectors.withColumn("updated_at", F.lit(2)), lambda df: df)[1]


@query("ret09_hits", """WITH k AS (SELECT vec_id * 3 AS entry_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS rank FROM embeddings), e AS (SELECT entry_id, CASE WHEN entry_id % 7 = 0 THEN NULL ELSE title END AS title, type, lineage_id * 2 AS lineage_id, branch_id FROM v_entries)
SELECT e.entry_id, type, coalesce(title, '') AS title, rank, round(1 - rank / 501.0, 3) AS score, coalesce(l.name, '') AS lineage_name, coalesce(b.name, '') AS branch_name FROM k JOIN e USING (entry_id) LEFT JOIN v_lineages l USING (lineage_id) LEFT JOIN v_branches b ON b.branch_id = e.branch_id WHERE rank < 500""")
def ret09(m):
    from pyspark.sql import Window as W

    ranked = m.table("embeddings").orderBy(F.desc("vec_id")).limit(500).select((F.col("vec_id") * 3).alias("entry_id"), (F.row_number().over(W.orderBy(F.desc("vec_id"))) - 1).cast("long").alias("rank"))
    e = m.entries.withColumn("title", F.when(F.col("entry_id") % 7 != 0, F.col("title"))).withColumn("lineage_id", F.col("lineage_id") * 2)
    return T.assembled(ranked, e, m.lineages, m.branches, 500).select("entry_id", "type", "title", "rank", "score", "lineage_name", "branch_name")


@query("ret16_introductions", """WITH p AS (SELECT person_id, name, birth_year, CASE WHEN person_id % 3 = 0 THEN '' ELSE birth_place END AS birth_place, CASE WHEN person_id % 4 <> 0 THEN generation END AS generation FROM v_persons),
own AS (SELECT entry_id % 100 AS person_id, row_number() OVER (PARTITION BY entry_id % 100 ORDER BY entry_id) AS r, 'person' AS scope, type, title, substring(text, 1, 400) AS text FROM v_entries WHERE trim(text) <> '' AND entry_id % 100 < 40),
fnd AS (SELECT entry_id % 100 AS person_id, row_number() OVER (PARTITION BY entry_id % 100 ORDER BY entry_id) AS r, 'lineage' AS scope, type, title, substring(text, 1, 400) AS text FROM v_entries WHERE trim(text) <> '' AND entry_id % 100 BETWEEN 20 AND 79),
u AS (SELECT * FROM own WHERE r <= 8 UNION ALL SELECT * FROM fnd WHERE r <= 6 AND person_id NOT IN (SELECT person_id FROM own)), c AS (SELECT person_id, string_agg(concat('〔', scope, '·', type, '〕', title, chr(10), text), chr(10) || chr(10) ORDER BY r) AS context, count(*) AS sources FROM u GROUP BY 1)
SELECT person_id, name, coalesce(nullif(concat_ws('；', CASE WHEN birth_year IS NOT NULL THEN concat('生卒 ', CAST(birth_year AS VARCHAR), '—?') END, CASE WHEN birth_place <> '' THEN concat('籍贯 ', birth_place) END, CASE WHEN generation IS NOT NULL THEN concat('第', CAST(generation AS VARCHAR), '代') END), ''), '暂无额外结构化信息') AS facts, context, sources FROM p JOIN c USING (person_id)""")
def ret16(m):
    people = m.persons.select("person_id", "name", "birth_year", F.lit(None).cast("int").alias("death_year"), F.when(F.col("person_id") % 3 == 0, "").otherwise(F.col("birth_place")).alias("birth_place"), F.when(F.col("person_id") % 4 != 0, F.col("generation")).alias("generation"))
    rows = m.entries.select((F.col("entry_id") % 100).alias("person_id"), F.col("entry_id").alias("ord"), F.lit("person").alias("scope"), "type", "title", "text")
    return T.introduction(people, rows.where("person_id < 40"), rows.where("person_id between 20 and 79"))


@query("snk01_upsert_nodes", """WITH n AS (SELECT part_id AS person_id, max(CASE WHEN page_no % 2 = 0 THEN concat('new ', CAST(task_id AS VARCHAR)) END) AS name FROM v_pages GROUP BY 1)
SELECT coalesce(o.person_id, n.person_id) AS person_id, coalesce(n.name, o.name) AS name, CASE WHEN n.person_id IS NULL THEN 'kept' WHEN o.person_id IS NULL THEN 'inserted' ELSE 'updated' END AS state FROM v_persons o FULL JOIN n ON n.person_id = o.person_id""")
def snk01(m):
    new = m.pages.groupBy(F.col("part_id").alias("person_id")).agg(F.max(F.when(F.col("page_no") % 2 == 0, F.concat(F.lit("new "), F.col("task_id").cast("string")))).alias("name"))
    return M.upsert(m.persons.select("person_id", "name"), new, ["person_id"], ["name"])


@query("snk05_settings", """WITH o AS (SELECT concat('key', CAST(id % 97 AS VARCHAR)) AS key, arg_max(concat('old ', CAST(id AS VARCHAR)), id) AS value FROM v_audit WHERE id % 97 < 60 GROUP BY 1), n AS (SELECT concat('key', CAST(id % 97 AS VARCHAR)) AS key, arg_max(action, id) AS value FROM v_audit WHERE id % 97 >= 40 GROUP BY 1)
SELECT key, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (key)""")
def snk05(m):
    key = F.concat(F.lit("key"), (F.col("id") % 97).cast("string"))
    old = m.audit.where("id % 97 < 60").groupBy(key.alias("key")).agg(F.max_by(F.concat(F.lit("old "), F.col("id").cast("string")), "id").alias("value"))
    return M.put_settings(old, m.audit.where("id % 97 >= 40").select(key.alias("key"), F.col("action").alias("value"), F.col("id").alias("at")))


@query("src02_label_counts", "SELECT 'Person' AS label, count(*) AS n FROM v_persons UNION ALL SELECT 'Branch', count(*) FROM v_branches UNION ALL SELECT 'Lineage', count(*) FROM v_lineages")
def src02(m):
    return G.label_counts({"Person": m.persons, "Branch": m.branches, "Lineage": m.lineages})


@query("src03_scan_files", "SELECT file_name, regexp_matches(lower(file_name), '\\.(pdf|tif|tiff|png|jpg|jpeg|bmp|webp)$') AS accepted FROM (SELECT concat(action, CAST(id % 40 AS VARCHAR), ['.pdf', '.TIF', '.txt', '', '.jpeg', '.webp.zip', '.Png'][CAST(id % 7 + 1 AS BIGINT)]) AS file_name FROM v_audit)")
def src03(m):
    name = F.concat("action", (F.col("id") % 40).cast("string"), _pick([".pdf", ".TIF", ".txt", "", ".jpeg", ".webp.zip", ".Png"], F.col("id")))
    return m.audit.select(name.alias("file_name")).withColumn("accepted", files.accepted(F.col("file_name")))


@query("agg07_distinct_maps", """WITH d AS (SELECT DISTINCT b.lineage_id, i.person_id, b.branch_id, b.name FROM v_in_branch i JOIN v_branches b USING (branch_id)) SELECT lineage_id, count(DISTINCT person_id) AS persons, string_agg(DISTINCT concat(CAST(branch_id AS VARCHAR), ':', name), ',' ORDER BY concat(CAST(branch_id AS VARCHAR), ':', name)) AS branches FROM d GROUP BY 1""")
def agg07(m):
    rows = m.in_branch.join(m.branches, "branch_id")
    out = rows.groupBy("lineage_id").agg(F.count_distinct("person_id").alias("persons"), F.collect_set(F.concat(F.col("branch_id").cast("string"), F.lit(":"), "name")).alias("b"))
    return out.select("lineage_id", "persons", F.array_join(F.array_sort("b"), ",").alias("branches"))
