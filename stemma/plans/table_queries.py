"""Queries of filters, joins, aggregates and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators import tables as T
from ..operators.apply import merged_edges
from ..operators.networks import in_networks
from .registry import query


@query("rel01_entry_filter", "SELECT entry_id, type, page_no FROM v_entries WHERE lineage_id = 2 AND status = 'active'")
def rel01(m):
    return T.filtered(m.entries, ["type", "page_no", "entry_id"], lineage_id=2, status="active", type=None).select("entry_id", "type", "page_no")


@query("rel02_audit_search", "WITH f AS (SELECT * FROM v_audit WHERE detail ILIKE '%1%' OR action ILIKE '%1%') SELECT id, action, detail, (SELECT count(*) FROM f) AS total FROM f ORDER BY id DESC LIMIT 50 OFFSET 25")
def rel02(m):
    return T.searched(m.audit, "1", ["detail", "action"], "id", 25, 50).select("id", "action", "detail", "total")


@query("rel03_user_search", "SELECT id, username FROM v_users WHERE username ILIKE '%r#00000000%'")
def rel03(m):
    return m.users.where(F.col("username").ilike("%r#00000000%")).select("id", "username")


@query("rel04_in_null_range", "SELECT task_id FROM v_tasks WHERE status IN ('done', 'running') AND archived_at IS NULL AND created_at < TIMESTAMP '1996-01-01'")
def rel04(m):
    return m.tasks.where(F.col("status").isin("done", "running") & F.col("archived_at").isNull() & (F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("task_id")


@query("rel05_pending_extraction", "SELECT task_id FROM v_tasks WHERE status = 'pending' OR (status = 'running' AND (file_name LIKE '1%' OR file_name LIKE '2%'))")
def rel05(m):
    return m.tasks.where((F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("file_name").startswith("1") | F.col("file_name").startswith("2")))).select("task_id")


@query("rel06_newest_tasks", "SELECT task_id, created_at FROM v_tasks ORDER BY created_at DESC, task_id DESC LIMIT 6")
def rel06(m):
    return T.newest(m.tasks, "created_at", "task_id", 6).select("task_id", "created_at")


@query("rel07_queue_head", "SELECT task_id FROM v_tasks WHERE status = 'pending' ORDER BY created_at, task_id LIMIT 1")
def rel07(m):
    return T.oldest(m.tasks.where("status = 'pending'"), "created_at", "task_id").select("task_id")


@query("rel08_multi_field_search", "SELECT person_id FROM v_persons WHERE contains(lower(name), '12') OR contains(lower(birth_place), 'auto')")
def rel08(m):
    return m.persons.where(F.lower("name").contains("12") | F.lower("birth_place").contains("auto")).select("person_id")


@query("rel09_entry_types", "SELECT entry_id FROM v_entries WHERE type IN ('src9', 'src19') AND status = 'archived'")
def rel09(m):
    return m.entries.where(F.col("type").isin("src9", "src19") & (F.col("status") == "archived")).select("entry_id")


@query("rel10_custom_order", "SELECT task_id, row_number() OVER (ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, created_at, task_id) AS place FROM v_tasks QUALIFY place <= 40")
def rel10(m):
    from pyspark.sql import Window as W

    first = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).otherwise(2)
    top = m.tasks.orderBy(first, "created_at", "task_id").limit(40)
    return top.select("task_id", F.row_number().over(W.orderBy(first, "created_at", "task_id")).cast("long").alias("place"))


@query("rel11_visible_tasks", "SELECT task_id, u.id AS user_id FROM v_tasks t CROSS JOIN v_users u WHERE u.id IN (4, 7) AND (u.role = 'admin' OR t.created_by = u.id)")
def rel11(m):
    """Who asks is the query's parameter: an administrator and a viewer."""
    both = m.tasks.crossJoin(F.broadcast(m.users.where("id in (4, 7)")))  # two rows
    return T.visible(both, F.col("created_by"), F.col("id"), F.col("role")).select("task_id", F.col("id").alias("user_id"))


@query("rel11_permitted_users", "SELECT id FROM v_users WHERE full_name IS NULL OR list_has_any(string_split(full_name, ' '), ['User', 'none'])")
def rel11_permitted(m):
    return m.users.where(T.permitted(F.split("full_name", " "), ["User", "none"])).select("id")


@query("rel12_action_options", "SELECT DISTINCT action FROM v_audit")
def rel12(m):
    return m.audit.select("action").distinct().orderBy("action")


@query("rel13_first_seen", "SELECT name, min(person_id) AS person_id FROM v_dup_persons GROUP BY name")
def rel13(m):
    return T.first_seen(m.dup_persons, "name", "person_id").select("name", "person_id")


@query("rel14_valid_shares", "SELECT task_id FROM v_tasks WHERE status <> 'running' AND (archived_at IS NULL OR archived_at >= TIMESTAMP '1997-06-01')")
def rel14(m):
    return m.tasks.where(T.valid_at("1997-06-01", F.col("status") == "running", F.col("archived_at"))).select("task_id")


@query("rel15_networks", """WITH n AS (SELECT person_id AS k FROM v_persons), four AS (SELECT 10 * 16777216 + (k % 256) * 65536 + (k * 7 % 256) * 256 + k * 13 % 256 AS a, 16 + k % 17 AS bits FROM n WHERE k % 2 = 0), six AS (SELECT k % 4096 AS x, k % 32 AS lo, 44 + k % 85 AS bits FROM n WHERE k % 2 = 1),
e AS (SELECT id, id % 2 AS six, 10 * 16777216 + (id % 256) * 65536 + (id * 7 % 256) * 256 + id * 3 % 256 AS a, id % 4096 AS x, id % 16 AS lo FROM v_audit)
SELECT id FROM e WHERE CASE WHEN six = 0 THEN EXISTS (SELECT 1 FROM four f WHERE (e.a >> (32 - f.bits)) = (f.a >> (32 - f.bits))) ELSE EXISTS (SELECT 1 FROM six s WHERE CASE WHEN s.bits <= 48 THEN (e.x >> (48 - s.bits)) = (s.x >> (48 - s.bits)) ELSE e.x = s.x AND (e.lo >> least(63, 128 - s.bits)) = (s.lo >> least(63, 128 - s.bits)) END) END""")
def rel15(m):
    text = lambda c: c.cast("string")
    k, i = F.col("person_id").cast("long"), F.col("id").cast("long")
    four = F.concat(F.lit("10."), text(k % 256), F.lit("."), text(k * 7 % 256), F.lit("."), text(k * 13 % 256), F.lit("/"), text(k % 17 + 16))
    six = F.concat(F.lit("2001:db8:"), F.hex(k % 4096), F.lit("::"), F.hex(k % 32), F.lit("/"), text(k % 85 + 44))
    networks = m.persons.select(F.when(k % 2 == 0, four).otherwise(six).alias("cidr"))
    ip = F.when(i % 2 == 0, F.concat(F.lit("10."), text(i % 256), F.lit("."), text(i * 7 % 256), F.lit("."), text(i * 3 % 256))).otherwise(F.concat(F.lit("2001:DB8:"), F.hex(i % 4096), F.lit("::"), F.hex(i % 16)))
    return in_networks(m.audit.select("id", ip.alias("ip")), "ip", networks).select("id")


@query("jon01_entry_names", "SELECT e.entry_id, coalesce(l.name, '') AS lineage, coalesce(b.name, '') AS branch FROM v_entries e LEFT JOIN v_lineages l USING (lineage_id) LEFT JOIN v_branches b ON b.branch_id = e.branch_id")
def jon01(m):
    out = m.entries.join(m.lineages.select("lineage_id", F.col("name").alias("l")), "lineage_id", "left").join(m.branches.select("branch_id", F.col("name").alias("b")), "branch_id", "left")
    return out.select("entry_id", F.coalesce("l", F.lit("")).alias("lineage"), F.coalesce("b", F.lit("")).alias("branch"))


@query("jon02_entry_file", "SELECT e.entry_id, t.file_name FROM v_entries e LEFT JOIN v_tasks t ON t.task_id = e.entry_id")
def jon02(m):
    return m.entries.join(m.tasks.select(F.col("task_id").alias("entry_id"), "file_name"), "entry_id", "left").select("entry_id", "file_name")


@query("jon03_audit_users", "SELECT a.id, coalesce(nullif(u.full_name, ''), u.username) AS who FROM v_audit a LEFT JOIN v_users u ON u.id = a.user_id")
def jon03(m):
    return m.audit.join(m.users.select(F.col("id").alias("user_id"), F.coalesce(F.nullif("full_name", F.lit("")), "username").alias("who")), "user_id", "left").select("id", "who")


@query("jon04_ranked_hits", "SELECT e.entry_id, e.title, v.r AS place FROM (SELECT entry_id, row_number() OVER (ORDER BY entry_id % 97, entry_id) AS r FROM v_vectors) v JOIN v_entries e USING (entry_id) WHERE v.r <= 60")
def jon04(m):
    from pyspark.sql import Window as W

    hits = m.vectors.orderBy(F.col("entry_id") % 97, "entry_id").limit(60).select("entry_id", F.row_number().over(W.orderBy(F.col("entry_id") % 97, "entry_id")).cast("long").alias("place"))
    return m.entries.join(hits, "entry_id").select("entry_id", "title", "place")


@query("jon05_semi", "SELECT entry_id FROM v_entries WHERE entry_id IN (SELECT entry_id FROM v_vectors)")
def jon05(m):
    return m.entries.join(m.vectors.select("entry_id"), "entry_id", "left_semi").select("entry_id")


@query("jon06_anti", "SELECT entry_id FROM v_entries WHERE entry_id NOT IN (SELECT entry_id FROM v_vectors)")
def jon06(m):
    return m.entries.join(m.vectors.select("entry_id"), "entry_id", "left_anti").select("entry_id")


@query("jon07_optional_counts", "SELECT b.branch_id, count(i.person_id) AS n FROM v_branches b LEFT JOIN v_in_branch i ON i.branch_id = b.branch_id GROUP BY 1")
def jon07(m):
    return m.branches.join(m.in_branch, "branch_id", "left").groupBy("branch_id").agg(F.count("person_id").alias("n"))


@query("jon08_two_hops", "SELECT DISTINCT a.src, b.dst FROM v_parent_of a JOIN v_parent_of b ON b.src = a.dst")
def jon08(m):
    return m.parent_of.alias("a").join(m.parent_of.alias("b"), F.col("b.src") == F.col("a.dst")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).distinct()


@query("jon11_missing_in_graph", "SELECT DISTINCT person_id FROM v_pages WHERE person_id NOT IN (SELECT person_id FROM v_persons WHERE person_id % 3 = 0)")
def jon11(m):
    return m.pages.select("person_id").distinct().join(m.persons.where("person_id % 3 = 0").select("person_id"), "person_id", "left_anti")


@query("agg01_status_counts", "SELECT count(*) AS total, count_if(status = 'done') AS done, count_if(status = 'failed') AS failed, count_if(status IN ('running', 'pending')) AS running FROM v_tasks")
def agg01(m):
    return T.status_counts(m.tasks)


@query("agg02_page_totals", "SELECT count(*) AS pages, count_if(failed) AS failed, count_if(reviewed) AS reviewed FROM v_pages")
def agg02(m):
    return T.page_totals(m.pages)


@query("agg03_array_lengths", "SELECT action, CAST(sum(k) AS BIGINT) AS items FROM (SELECT action, CASE WHEN id % 4 = 0 THEN 0 ELSE id % 4 END AS k FROM v_audit) GROUP BY 1")
def agg03(m):
    n = (F.col("id") % 4).cast("int")
    json = F.when(n == 0, F.lit('{"failed": "none"}')).otherwise(F.concat(F.lit('{"failed": ['), F.array_join(F.array_repeat(F.lit("1"), n), ","), F.lit("]}")))
    return m.audit.withColumn("j", json).groupBy("action").agg(T.array_lengths(F.col("j"), "$.failed").alias("items"))


@query("agg04_generations", "SELECT CAST(generation AS VARCHAR) AS k, count(*) AS n FROM v_persons GROUP BY 1")
def agg04(m):
    return T.counted(m.persons, F.col("generation").cast("string")).orderBy("k")


@query("agg05_top_branches", "SELECT concat(coalesce(l.name, ''), '·', b.name) AS k, count(*) AS c FROM v_in_branch i JOIN v_branches b ON i.branch_id = b.branch_id LEFT JOIN v_lineages l ON l.lineage_id = b.lineage_id GROUP BY 1 ORDER BY c DESC, k LIMIT 10")
def agg05(m):
    return T.top_branches(m.in_branch, m.branches, m.lineages)


@query("agg06_genders", "SELECT coalesce(gender, 'unknown') AS k, count(*) AS n FROM v_persons GROUP BY 1")
def agg06(m):
    return T.counted(m.persons, F.coalesce("gender", F.lit("unknown")))


@query("agg08_pages_per_task", "SELECT task_id AS k, count(*) AS n FROM v_pages GROUP BY 1")
def agg08(m):
    return T.counted(m.pages, F.col("task_id"))


@query("agg09_latest", "SELECT max(created_at) AS latest FROM v_audit")
def agg09(m):
    return m.audit.agg(F.max("created_at").alias("latest"))


@query("agg10_failed_pages", "SELECT task_id, count_if(failed) AS failed FROM v_pages GROUP BY 1")
def agg10(m):
    return T.review_state(m.pages).select("task_id", "failed")


@query("agg11_review_state", "SELECT task_id, count(*) AS pages, count_if(failed) AS failed, count_if(reviewed) AS reviewed_pages, count_if(NOT failed) > 0 AND count_if(NOT failed) = count_if(NOT failed AND reviewed) AS reviewed FROM v_pages GROUP BY 1")
def agg11(m):
    return T.review_state(m.pages)


@query("agg12_prefix_sizes", "SELECT concat('scans/', CAST(task_id AS VARCHAR)) AS prefix, count(*) AS n, CAST(sum(part_id) AS BIGINT) AS bytes, max(page_no) AS latest FROM v_pages GROUP BY 1")
def agg12(m):
    objects = m.pages.select(F.concat(F.lit("scans/"), F.col("task_id").cast("string"), F.lit("/page_"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit(".png")).alias("name"), F.col("part_id").alias("size"), F.col("page_no").cast("long").alias("modified"))
    return T.prefix_sizes(objects)


@query("agg13_most_common", "SELECT user_id, max(n) AS n FROM (SELECT user_id, action, count(*) AS n FROM v_audit GROUP BY 1, 2) GROUP BY 1")
def agg13(m):
    return m.audit.groupBy("user_id", "action").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("n"))


@query("agg14_coverage", "SELECT 'gender' AS field, count(gender) AS filled FROM v_persons UNION ALL SELECT 'birth_year', count(birth_year) FROM v_persons UNION ALL SELECT 'name', count(name) FROM v_persons")
def agg14(m):
    return T.coverage(m.persons, ["gender", "birth_year", "name"])


@query("agg15_progress", "SELECT task_id, CAST(least(100, floor(count_if(NOT failed) * 100 / count(*) + 0.5)) AS BIGINT) AS progress FROM v_pages GROUP BY 1")
def agg15(m):
    return m.pages.groupBy("task_id").agg(T.percent(F.count_if(~F.col("failed")), F.count("*")).alias("progress"))


@query("agg15_bars", "WITH c AS (SELECT type, count(*) AS n FROM v_entries GROUP BY 1) SELECT type, n, CAST(greatest(2, floor(n * 100.0 / (SELECT max(n) FROM c) + 0.5)) AS BIGINT) AS bar FROM c")
def agg15_bars(m):
    return T.bars(m.entries.groupBy("type").agg(F.count("*").alias("n")), "n")


@query("agg16_sparkline", "WITH e AS (SELECT action, min(value) AS lo, max(value) AS hi FROM v_audit GROUP BY 1) SELECT id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM v_audit JOIN e USING (action)")
def agg16(m):
    return T.scaled(m.audit, "action", "value").select("id", F.round("scaled", 6).alias("scaled"))


@query("gov01_duplicate_files", """WITH k AS (SELECT task_id, created_at, CASE WHEN task_id % 3 = 0 THEN concat('d|', CAST(created_by % 50 AS VARCHAR)) ELSE concat('n|', CAST(CAST(floor(file_size) AS BIGINT) % 300 AS VARCHAR), '|', file_name) END AS key, status FROM v_tasks),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, task_id DESC) AS r FROM k WHERE status <> 'failed'), f AS (SELECT key, max(CASE WHEN r = 1 THEN task_id END) AS a, max(CASE WHEN r = 2 THEN task_id END) AS b FROM r GROUP BY 1)
SELECT k.task_id, CASE WHEN a <> k.task_id THEN a ELSE b END AS duplicate_of FROM k JOIN f USING (key) WHERE CASE WHEN a <> k.task_id THEN a ELSE b END IS NOT NULL""")
def gov01(m):
    rows = m.tasks.select("task_id", "status", "created_at", "file_name", F.when(F.col("task_id") % 3 == 0, (F.col("created_by") % 50).cast("string")).alias("file_sha256"), (F.floor("file_size") % 300).alias("file_size"))
    return M.duplicate_files(rows)


@query("gov02_tasks_by_name", """WITH n AS (SELECT DISTINCT replace(replace(file_name, '/', ''), '-', '_') AS name FROM v_tasks UNION SELECT concat('none', CAST(id % 5 AS VARCHAR)) FROM v_users),
k AS (SELECT task_id, CASE WHEN task_id % 7 = 3 THEN 'failed' ELSE status END AS status, replace(file_name, '-', '_') AS name, file_size, created_at FROM v_tasks),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, task_id DESC) AS r FROM k WHERE status <> 'failed') SELECT n.name, r, task_id, status, file_size, created_at FROM n LEFT JOIN r ON r.name = n.name""")
def gov02(m):
    odd = m.tasks.select(F.concat(F.lit("up\\load/"), F.replace("file_name", F.lit("-"), F.lit("?"))).alias("file_name"))
    none = m.users.select(F.concat(F.lit("a/b/none"), (F.col("id") % 5).cast("string")).alias("file_name"))
    path = F.concat(F.lit("tasks/"), F.col("task_id").cast("string"), F.lit("/"), F.replace("file_name", F.lit("-"), F.lit("_")))
    tasks = m.tasks.withColumn("file_path", path).withColumn("status", F.when(F.col("task_id") % 7 == 3, "failed").otherwise(F.col("status")))
    return M.tasks_by_name(odd.unionByName(none), tasks)


_LISTED = """f AS (SELECT concat('tasks/', CAST(task_id AS VARCHAR), '/page_', CAST(page_no AS VARCHAR), '.png') AS path, part_id AS bytes, page_no AS mtime FROM v_pages UNION ALL SELECT concat('other/', CAST(id AS VARCHAR), '/x'), 5, 1 FROM v_users UNION ALL SELECT concat(username, '.pdf'), id, 7 FROM v_users),
s AS (SELECT concat('scans/', CAST(task_id AS VARCHAR), '/', CAST(page_no AS VARCHAR)) AS path, part_id * 2 AS bytes, CASE WHEN page_no % 3 <> 0 THEN 100 - page_no END AS mtime FROM v_pages WHERE task_id % 2 = 0 UNION ALL SELECT concat('scans/', CAST(id AS VARCHAR)), 1, 1 FROM v_users),
k AS (SELECT CAST(task_id AS VARCHAR) AS name FROM v_tasks WHERE task_id % 5 <> 1),
o AS (SELECT concat('local:', name) AS key, 'local_dir' AS kind, name, concat('tasks/', name) AS path, CAST(sum(bytes) AS BIGINT) AS size, count(*) AS files, CAST(max(mtime) AS VARCHAR) AS mtime FROM (SELECT split_part(path, '/', 2) AS name, bytes, mtime FROM f WHERE starts_with(path, 'tasks/')) WHERE name NOT IN (SELECT name FROM k) GROUP BY name
UNION ALL SELECT concat('minio:', name), 'minio_prefix', name, concat('scans/', name, '/'), CAST(sum(bytes) AS BIGINT), count(*), CAST(arg_max(mtime, path) FILTER (mtime IS NOT NULL) AS VARCHAR) FROM (SELECT split_part(path, '/', 2) AS name, path, bytes, mtime FROM s WHERE split_part(path, '/', 3) <> '') WHERE name NOT IN (SELECT name FROM k) GROUP BY name
UNION ALL SELECT concat('file:', path), 'loose_file', path, path, bytes, 1, CAST(mtime AS VARCHAR) FROM f WHERE NOT contains(path, '/')
UNION ALL SELECT concat('content:', CAST(lineage_id AS VARCHAR)), 'orphan_content', CAST(lineage_id AS VARCHAR), concat('lineage_id=', CAST(lineage_id AS VARCHAR)), 0, count(*), '' FROM v_entries WHERE lineage_id NOT IN (SELECT lineage_id FROM v_lineages WHERE lineage_id < 3) GROUP BY lineage_id)"""


@query("gov03_orphans", f"WITH {_LISTED} SELECT * FROM o")
def gov03(m):
    return _orphans(m)


@query("gov03_totals", f"WITH {_LISTED} SELECT count(*) AS total_items, CAST(sum(size) AS BIGINT) AS total_size FROM o")
def gov03_totals(m):
    return M.orphan_totals(_orphans(m))


def _orphans(m):
    text = lambda c: F.col(c).cast("string")
    pages = m.pages.select(F.concat(F.lit("tasks/"), text("task_id"), F.lit("/page_"), text("page_no"), F.lit(".png")).alias("path"), F.col("part_id").alias("bytes"), F.col("page_no").cast("long").alias("mtime"))
    other = m.users.select(F.concat(F.lit("other/"), text("id"), F.lit("/x")).alias("path"), F.lit(5).alias("bytes"), F.lit(1).cast("long").alias("mtime"))
    loose = m.users.select(F.concat("username", F.lit(".pdf")).alias("path"), F.col("id").alias("bytes"), F.lit(7).cast("long").alias("mtime"))
    stored = m.pages.where("task_id % 2 = 0").select(F.concat(F.lit("scans/"), text("task_id"), F.lit("/"), text("page_no")).alias("path"), (F.col("part_id") * 2).alias("bytes"), F.when(F.col("page_no") % 3 != 0, 100 - F.col("page_no")).cast("long").alias("mtime"))
    bare = m.users.select(F.concat(F.lit("scans/"), text("id")).alias("path"), F.lit(1).alias("bytes"), F.lit(1).cast("long").alias("mtime"))
    return M.orphans(pages.unionByName(other).unionByName(loose), stored.unionByName(bare), m.tasks.where("task_id % 5 <> 1"), m.entries, m.lineages.where("lineage_id < 3"))


@query("gov04_cleanup", f"""WITH {_LISTED}, w AS (SELECT 'local_dir' AS kind, CAST(task_id AS VARCHAR) AS id FROM v_tasks WHERE task_id % 10 < 3 UNION ALL SELECT 'loose_file', concat(username, '.pdf') FROM v_users WHERE id % 2 = 0 UNION ALL SELECT 'orphan_content', CAST(lineage_id AS VARCHAR) FROM v_lineages)
SELECT w.kind, w.id, CASE WHEN o.name IS NULL THEN 'skipped' ELSE 'removed' END AS outcome, coalesce(o.size, 0) AS freed FROM w LEFT JOIN o ON o.kind = w.kind AND o.name = w.id""")
def gov04(m):
    text = lambda c: F.col(c).cast("string").alias("id")
    wanted = m.tasks.where("task_id % 10 < 3").select(F.lit("local_dir").alias("kind"), text("task_id")).unionByName(m.users.where("id % 2 = 0").select(F.lit("loose_file").alias("kind"), F.concat("username", F.lit(".pdf")).alias("id"))).unionByName(m.lineages.select(F.lit("orphan_content").alias("kind"), text("lineage_id")))
    return M.cleaned(wanted, _orphans(m).select("kind", F.col("name").alias("id"), F.col("size").alias("bytes")))


@query("gov05_delete_requests", """WITH r AS (SELECT id AS request_id, CASE WHEN id % 2 = 0 THEN 'lineage' ELSE 'task' END AS target_type, user_id AS target_id, CASE WHEN id % 7 = 0 THEN 'approved' ELSE 'pending' END AS status, concat(CAST(user_id % 9 AS VARCHAR), CASE WHEN id % 5 = 0 THEN 'x' ELSE '' END) AS snapshot, id % 11 <> 0 AS approve, id % 3 = 0 AS force FROM v_audit),
c AS (SELECT 'lineage' AS target_type, person_id AS target_id, person_id % 3 AS n, false AS archived, CAST(person_id % 9 AS VARCHAR) AS state FROM v_persons UNION ALL SELECT 'task', task_id, 0, archived_at IS NOT NULL, CAST(task_id % 9 AS VARCHAR) FROM v_tasks)
SELECT request_id, r.target_type, r.target_id, CASE WHEN status <> 'pending' THEN 'handled already' WHEN NOT approve THEN 'rejected' WHEN n IS NULL THEN 'approved, gone already' WHEN archived THEN 'refused, archived' WHEN r.target_type = 'lineage' AND n > 0 AND NOT force THEN 'needs force' ELSE 'approved, deleted' END AS outcome, n IS NOT NULL AND snapshot <> state AS changed FROM r LEFT JOIN c USING (target_type, target_id)""")
def gov05(m):
    kind = F.when(F.col("id") % 2 == 0, "lineage").otherwise("task")
    state = lambda c: F.struct((c % 9).cast("string").alias("s"))
    then = F.struct(F.concat((F.col("user_id") % 9).cast("string"), F.when(F.col("id") % 5 == 0, "x").otherwise("")).alias("s"))
    requests = m.audit.select(F.col("id").alias("request_id"), kind.alias("target_type"), F.col("user_id").alias("target_id"), F.when(F.col("id") % 7 == 0, "approved").otherwise("pending").alias("status"), then.alias("snapshot"), (F.col("id") % 11 != 0).alias("approve"), (F.col("id") % 3 == 0).alias("force"))
    lineages = m.persons.select(F.lit("lineage").alias("target_type"), F.col("person_id").alias("target_id"), (F.col("person_id") % 3).alias("n"), F.lit(False).alias("archived"), state(F.col("person_id")).alias("state"))
    tasks = m.tasks.select(F.lit("task").alias("target_type"), F.col("task_id").alias("target_id"), F.lit(0).cast("long").alias("n"), F.col("archived_at").isNotNull().alias("archived"), state(F.col("task_id")).alias("state"))
    return M.decide_requests(requests, lineages.unionByName(tasks))


@query("gov05_submitted", """WITH w AS (SELECT id AS asked, user_id AS target_id, user_id % 13 AS submitted_by, row_number() OVER (PARTITION BY user_id ORDER BY id) AS turn FROM v_audit WHERE id % 2 = 1), p AS (SELECT user_id AS target_id, min(id) AS conflict FROM v_audit WHERE id % 2 = 0 AND id % 3 <> 0 AND user_id % 4 = 0 GROUP BY 1)
SELECT asked, target_id, submitted_by, conflict, CASE WHEN conflict IS NOT NULL OR turn > 1 THEN 'conflict' ELSE 'pending' END AS outcome FROM w LEFT JOIN p USING (target_id)""")
def gov05_submitted(m):
    wanted = m.audit.where("id % 2 = 1").select(F.lit("task").alias("target_type"), F.col("user_id").alias("target_id"), (F.col("user_id") % 13).alias("submitted_by"), F.col("id").alias("at"))
    before = m.audit.where("id % 2 = 0").select(F.col("id").alias("request_id"), F.when(F.col("user_id") % 4 == 0, "task").otherwise("lineage").alias("target_type"), F.col("user_id").alias("target_id"), F.when(F.col("id") % 3 == 0, "approved").otherwise("pending").alias("status"))
    return M.submit_requests(wanted, before).drop("target_type").withColumnRenamed("at", "asked")


@query("gov06_review_gate", "SELECT task_id, page_no, CASE WHEN reviewed THEN 'pass' WHEN failed THEN 'forced' WHEN page_no % 2 = 0 THEN 'reasoned' ELSE 'refused' END AS gate FROM v_pages")
def gov06(m):
    return m.pages.select("task_id", F.col("page_no").cast("long").alias("page_no"), M.review_gate(F.col("reviewed"), F.when(F.col("page_no") % 2 == 0, "why").otherwise(" "), F.col("failed")).alias("gate"))


@query("gov07_reviewed_source", "SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'payload' WHEN entry_id % 3 = 1 THEN 'consolidated' ELSE 'pages' END AS source FROM v_entries")
def gov07(m):
    arr = lambda k, name: F.when(F.col("entry_id") % 3 == k, F.array(F.lit(name)))
    return m.entries.select("entry_id", F.element_at(M.reviewed_source(arr(0, "payload"), arr(1, "consolidated"), F.array(F.lit("pages"))), 1).alias("source"))


@query("gov08_archived", """WITH t AS (SELECT task_id, status, archived_at, task_id % 3 <> 0 AS applied, task_id % 2 = 0 AS asked FROM v_tasks)
SELECT task_id, CASE WHEN NOT asked THEN NULL WHEN archived_at IS NOT NULL THEN 'archived already' WHEN status <> 'done' THEN 'not recognised' WHEN NOT applied THEN 'not applied' ELSE 'archived' END AS outcome, archived_at IS NOT NULL OR (asked AND status = 'done' AND applied) AS archived FROM t""")
def gov08(m):
    tasks = m.tasks.select("task_id", "status", "archived_at", F.when(F.col("task_id") % 3 != 0, F.col("created_at")).alias("applied_at"), F.lit(None).cast("long").alias("archived_by"))
    out = M.archived(tasks, m.tasks.where("task_id % 2 = 0").select("task_id"), 1, F.lit("2030-01-01").cast(dict(m.tasks.dtypes)["archived_at"]))
    return out.select("task_id", "outcome", F.col("archived_at").isNotNull().alias("archived"))


@query("gov08_unarchived", """SELECT task_id, CASE WHEN task_id % 2 = 1 THEN NULL WHEN archived_at IS NULL THEN 'not archived' ELSE 'fetched back' END AS outcome, archived_at IS NOT NULL AND task_id % 2 = 1 AS archived, archived_at IS NOT NULL AND task_id % 2 = 0 AS purge FROM v_tasks""")
def gov08_back(m):
    out = M.unarchived(m.tasks, m.tasks.where("task_id % 2 = 0").select("task_id"))
    return out.select("task_id", "outcome", F.col("archived_at").isNotNull().alias("archived"), "purge")


_TASKS = """k AS (SELECT task_id, CASE WHEN task_id % 9 = 1 THEN NULL ELSE concat('tasks/', CAST(task_id AS VARCHAR), '/', file_name, '.pdf') END AS file_path, 'pdf' AS file_type, file_size, CASE WHEN task_id % 4 = 0 THEN NULL ELSE task_id % 30 END AS total_pages, task_id % 20 AS done_pages, status, CASE WHEN task_id % 3 = 0 THEN 'extracting' END AS stage, CASE WHEN task_id % 8 = 0 THEN 'user' END AS pause_reason, CASE WHEN task_id % 10 = 0 THEN 'error' END AS error_msg, CASE WHEN task_id % 5 <> 0 THEN task_id % 7 END AS lineage_id, task_id % 30 AS branch_id,
CASE WHEN task_id % 6 = 5 THEN created_at END AS applied_at, archived_at, CASE WHEN archived_at IS NOT NULL THEN created_by % 200 END AS archived_by, created_at, created_at AS updated_at, CASE WHEN task_id % 11 = 0 THEN task_id % 3 END AS failed_listed, task_id % 3 = 1 AS consolidated, CASE WHEN task_id % 2 = 0 THEN true WHEN task_id % 5 = 1 THEN false END AS volume_reviewed, 'then' AS volume_reviewed_at, 'someone' AS volume_reviewed_by, CASE WHEN task_id % 13 = 0 THEN true WHEN task_id % 13 = 1 THEN false END AS stale FROM v_tasks)"""


@query("gov09_task_list", f"""WITH {_TASKS}, s AS (SELECT task_id, count(*) AS pages, count_if(failed) AS failed, count_if(reviewed) AS reviewed, count_if(NOT failed) AS good, count_if(NOT failed AND reviewed) AS fine, sum(CASE WHEN task_id % 4 = 1 THEN 0 ELSE part_id % 2 END) AS relations FROM v_pages WHERE task_id % 10 <> 7 GROUP BY 1)
SELECT k.task_id, coalesce(split_part(file_path, '/', 3), '') AS file_path, file_type, file_size, CAST(coalesce(total_pages, 0) AS BIGINT) AS total_pages, CAST(done_pages AS BIGINT) AS done_pages, CAST(coalesce(failed_listed, s.failed, 0) AS BIGINT) AS failed_pages, status, coalesce(stage, '') AS stage, pause_reason, error_msg, k.lineage_id, l.name AS lineage_name, k.branch_id, b.name AS branch_name,
applied_at IS NOT NULL OR k.task_id % 50 = 2 AS applied, applied_at, CASE WHEN consolidated THEN coalesce(volume_reviewed, false) ELSE coalesce(good, 0) > 0 AND good = fine END AS reviewed, CASE WHEN consolidated THEN volume_reviewed_at END AS reviewed_at, CASE WHEN consolidated THEN volume_reviewed_by END AS reviewed_by_name, coalesce(s.reviewed, 0) AS reviewed_pages, coalesce(s.pages, 0) AS review_total_pages,
coalesce(stale, false) OR (NOT consolidated AND coalesce(s.pages, 0) > 0 AND s.relations = 0 AND status = 'done') AS needs_reconsolidate, coalesce(s.pages, 0) > 0 OR k.task_id % 20 = 7 AS can_resume, archived_at IS NOT NULL AS archived, archived_at, archived_by, u.username AS archived_by_name, created_at, updated_at
FROM k LEFT JOIN s ON s.task_id = k.task_id LEFT JOIN v_lineages l ON l.lineage_id = k.lineage_id LEFT JOIN v_branches b ON b.branch_id = k.branch_id LEFT JOIN v_users u ON u.id = k.archived_by""")
def gov09(m):
    tasks = m.spark.sql(f"WITH {_TASKS.replace('VARCHAR', 'STRING').replace('FROM v_tasks', 'FROM {v_tasks}')} SELECT * FROM k", v_tasks=m.tasks)
    pages = m.pages.where("task_id % 10 <> 7").select("task_id", "failed", "reviewed", F.when(F.col("task_id") % 4 == 1, 0).otherwise(F.col("part_id") % 2).alias("relations"))
    return T.task_list(tasks, pages, m.lineages, m.branches, m.users, m.tasks.where("task_id % 50 = 2"), m.tasks.where("task_id % 20 = 7"))


@query("gov11_changed_pages", "SELECT task_id, page_no FROM v_pages WHERE page_no % 5 = 0 OR page_no > 6")
def gov11(m):
    sign = lambda x: F.sha2(F.concat_ws("|", F.col("part_id").cast("string"), x), 256)
    now = m.pages.select("task_id", "page_no", sign(F.when(F.col("page_no") % 5 == 0, "new").otherwise("")).alias("signature"))
    before = m.pages.where("page_no <= 6").select("task_id", "page_no", sign(F.lit("")).alias("signature"))
    return M.changed_pages(now, before).withColumn("page_no", F.col("page_no").cast("long"))


@query("gov12_colours", "SELECT DISTINCT type, CASE WHEN length(type) = 4 THEN (ascii('s') * 29791 + ascii('r') * 961 + ascii('c') * 31 + ascii(substring(type, 4, 1))) % 12 ELSE (((ascii('s') * 29791 + ascii('r') * 961 + ascii('c') * 31 + ascii(substring(type, 4, 1))) * 31) + ascii(substring(type, 5, 1))) % 4294967296 % 12 END AS colour FROM v_entries")
def gov12(m):
    return m.entries.select("type").distinct().select("type", T.colour_of(F.col("type"), 12).alias("colour"))


@query("str01_rates", "SELECT id, round(CASE WHEN s > 0 THEN greatest(0.0, value - b) / (s / 1e6) END, 6) AS rate FROM (SELECT id, value, lag(value) OVER w AS b, epoch_us(created_at) - epoch_us(lag(created_at) OVER w) AS s FROM v_audit WINDOW w AS (PARTITION BY action ORDER BY created_at, id))")
def str01(m):
    return T.rates(m.audit, "action", "created_at", "value").select("id", F.round("rate", 6).alias("rate"))


@query("str02_last_samples", "SELECT id, action FROM v_audit QUALIFY row_number() OVER (PARTITION BY action ORDER BY created_at DESC, id DESC) <= 60")
def str02(m):
    return T.last_samples(m.audit, "action", "created_at").select("id", "action")


@query("str03_gauges", "SELECT device, total, total - available AS used, round((total - available) * 100 / total, 1) AS used_percent FROM (SELECT n_name AS device, CAST(n_nationkey * 1000 + 500 AS BIGINT) AS total, CAST(n_nationkey * 300 AS BIGINT) AS available FROM nation WHERE n_nationkey % 4 <> 1) ORDER BY total DESC, device LIMIT 6")
def str03(m):
    mounts = m.table("nation").select(F.col("n_name").alias("device"), F.lit("/m").alias("mount"), F.when(F.col("n_nationkey") % 4 == 1, "tmpfs").otherwise("ext4").alias("kind"), (F.col("n_nationkey") * 1000 + 500).cast("long").alias("total"), (F.col("n_nationkey") * 300).cast("long").alias("available"))
    return T.gauges(mounts.unionByName(mounts.withColumn("mount", F.lit("/n")))).select("device", "total", "used", "used_percent")


@query("str04_time_left", """WITH s AS (SELECT user_id, action, min((created_at, id % 50)) AS a, max((created_at, id % 50)) AS b FROM v_audit GROUP BY 1, 2)
SELECT user_id AS task_id, action AS stage, round(CASE WHEN b[2] - a[2] > 0 THEN (epoch_us(b[1]) - epoch_us(a[1])) / 1e6 / (b[2] - a[2]) * greatest(0, 60 - b[2]) END, 3) AS seconds_left FROM s""")
def str04(m):
    s = m.audit.select(F.col("user_id").alias("task_id"), F.col("action").alias("stage"), F.col("created_at").alias("at"), (F.col("id") % 50).alias("done"), F.lit(60).alias("total"))
    return T.time_left(s).withColumn("seconds_left", F.round("seconds_left", 3))


@query("str06_expired", "SELECT id FROM v_audit WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS")
def str06(m):
    return M.expired(m.audit, "2024-01-31", 10).select("id")


@query("str07_task_states", """WITH RECURSIVE e AS (SELECT user_id % 200 AS task_id, ['start', 'pause', 'resume', 'finish', 'error', 'progress', 'restart'][CAST(id * 7919 % 7 + 1 AS BIGINT)] AS event, row_number() OVER (PARTITION BY user_id % 200 ORDER BY created_at, id) AS r FROM v_audit),
f AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS r, 'pending' AS s FROM e UNION ALL SELECT f.task_id, e.r, CASE WHEN event = 'restart' THEN 'running' WHEN s IN ('done', 'failed') THEN s WHEN s = 'paused' THEN CASE event WHEN 'resume' THEN 'running' ELSE 'paused' END WHEN event = 'pause' THEN 'paused' WHEN event = 'start' THEN 'running' WHEN event = 'finish' THEN 'done' WHEN event = 'error' THEN 'failed' ELSE s END FROM f JOIN e ON e.task_id = f.task_id AND e.r = f.r + 1)
SELECT task_id, arg_max(s, r) AS status FROM f GROUP BY 1""")
def str07(m):
    names = F.array(*map(F.lit, ("start", "pause", "resume", "finish", "error", "progress", "restart")))
    events = m.audit.select((F.col("user_id") % 200).alias("task_id"), F.struct("created_at", "id").alias("at"), F.element_at(names, (F.pmod(F.col("id") * 7919, F.lit(7)) + 1).cast("int")).alias("event"))
    return M.task_states(events)


@query("str08_recovery", """WITH p AS (SELECT task_id, count(*) AS pages FROM v_pages WHERE page_no > 4 GROUP BY 1), t AS (SELECT task_id, CASE task_id % 4 WHEN 0 THEN 'consolidating' WHEN 1 THEN 'ready' ELSE 'extracting' END AS stage, created_by % 3 = 0 AS has_file FROM v_tasks WHERE status = 'running')
SELECT task_id, stage, coalesce(pages, 0) AS pages, CASE WHEN stage = 'consolidating' THEN 'pending' WHEN stage = 'ready' THEN 'paused' WHEN has_file THEN 'pending' WHEN coalesce(pages, 0) > 0 THEN 'paused' ELSE 'failed' END AS status FROM t LEFT JOIN p USING (task_id)""")
def str08(m):
    stage = F.when(F.col("task_id") % 4 == 0, "consolidating").when(F.col("task_id") % 4 == 1, "ready").otherwise("extracting")
    tasks = m.tasks.where("status = 'running'").select("task_id", stage.alias("stage"), (F.col("created_by") % 3 == 0).alias("has_file"))
    return M.recovery(tasks, m.pages.where("page_no > 4").groupBy("task_id").agg(F.count("*").alias("pages")))


@query("str10_has_work", "SELECT task_id, count_if(failed) > 0 OR count(*) < 5 AS work FROM v_pages GROUP BY 1")
def str10(m):
    return m.pages.groupBy("task_id").agg(F.count_if("failed").alias("f"), F.count("*").alias("n")).select("task_id", M.has_work(F.lit(5), F.col("n"), F.col("f")).alias("work"))


@query("str12_pages_to_do", "SELECT task_id, page_no FROM v_pages WHERE failed OR NOT reviewed")
def str12(m):
    return M.pages_to_do(m.pages, m.pages.where("not failed and reviewed")).withColumn("page_no", F.col("page_no").cast("long"))


@query("snk02_upsert_edges", """WITH o AS (SELECT CASE WHEN dst % 2 = 0 THEN 'spouse' ELSE 'parent_child' END AS type, src, dst, CASE WHEN dst % 3 <> 0 THEN concat('r', CAST(dst AS VARCHAR), '-', CAST(src AS VARCHAR)) END AS rel_id, CASE WHEN dst % 5 = 0 THEN 'old day' END AS marriage_date FROM (SELECT DISTINCT src, dst FROM v_parent_of)),
n AS (SELECT type, src, dst, CASE WHEN dst % 4 = 0 THEN 'new day' END AS marriage_date FROM o WHERE dst % 7 < 3 UNION ALL SELECT 'spouse', src, dst + 100000, 'first day' FROM v_spouse_of)
SELECT coalesce(n.type, o.type) AS type, coalesce(n.src, o.src) AS src, coalesce(n.dst, o.dst) AS dst, CASE WHEN n.type IS NULL THEN o.rel_id ELSE coalesce(o.rel_id, left(sha256(concat_ws('|', n.type, CAST(n.src AS VARCHAR), CAST(n.dst AS VARCHAR))), 24)) END AS rel_id, CASE WHEN n.type IS NULL THEN o.marriage_date ELSE n.marriage_date END AS marriage_date FROM n FULL JOIN o ON o.type = n.type AND o.src = n.src AND o.dst = n.dst""")
def snk02(m):
    d = F.col("dst")
    rel = F.concat(F.lit("r"), d.cast("string"), F.lit("-"), F.col("src").cast("string"))
    old = m.parent_of.select("src", "dst").distinct().select(F.when(d % 2 == 0, "spouse").otherwise("parent_child").alias("type"), "src", "dst", F.when(d % 3 != 0, rel).alias("rel_id"), F.when(d % 5 == 0, "old day").alias("marriage_date"))
    again = old.where("dst % 7 < 3").select("type", "src", "dst", F.when(d % 4 == 0, "new day").alias("marriage_date"))
    first = m.spouse_of.select(F.lit("spouse").alias("type"), "src", (d + 100000).alias("dst"), F.lit("first day").alias("marriage_date"))
    return merged_edges(old, again.unionByName(first))


@query("snk03_upsert_entries", """SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, coalesce(n.title, o.title) AS title, CASE WHEN n.entry_id IS NULL THEN 'kept' WHEN o.entry_id IS NULL THEN 'inserted' ELSE 'updated' END AS state
FROM (SELECT entry_id, title FROM v_entries WHERE entry_id % 3 <> 0) o FULL JOIN (SELECT entry_id, concat(title, '!') AS title FROM v_entries WHERE entry_id % 2 = 0) n ON n.entry_id = o.entry_id""")
def snk03(m):
    return M.upsert(m.entries.where("entry_id % 3 <> 0"), m.entries.where("entry_id % 2 = 0").withColumn("title", F.concat("title", F.lit("!"))), ["entry_id"], ["title"])


@query("snk04_replace_tasks", "SELECT task_id, page_no, failed FROM v_pages WHERE task_id % 4 <> 0 UNION ALL SELECT task_id, page_no, NOT failed FROM v_pages WHERE task_id % 4 = 0 AND page_no <= 2")
def snk04(m):
    old = m.pages.select("task_id", "page_no", "failed")
    fresh = old.where("task_id % 4 = 0 and page_no <= 2").withColumn("failed", ~F.col("failed"))
    return M.replace_tasks(old, fresh).withColumn("page_no", F.col("page_no").cast("long"))


@query("snk06_bulk_delete", "SELECT id FROM v_audit WHERE id NOT IN (SELECT entry_id FROM v_entries WHERE status = 'archived')")
def snk06(m):
    return m.audit.join(m.entries.where("status = 'archived'").select(F.col("entry_id").alias("id")), "id", "left_anti").select("id")


@query("src05_objects_by_prefix", "SELECT task_id, count(*) AS n FROM v_pages WHERE CAST(task_id AS VARCHAR) LIKE '12%' GROUP BY 1")
def src05(m):
    objects = m.pages.select("task_id", F.concat(F.lit("scans/"), F.col("task_id").cast("string"), F.lit("/x")).alias("name"))
    return objects.where(F.col("name").startswith("scans/12")).groupBy("task_id").agg(F.count("*").alias("n"))


@query("src06_page_of_object", "SELECT task_id, page_no FROM v_pages")
def src06(m):
    name = F.concat(F.lit("scans/"), F.col("task_id").cast("string"), F.lit("/page_"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit(".png"))
    return m.pages.select("task_id", T.page_of_object(name).cast("long").alias("page_no"))


@query("src07_documents_list", "SELECT entry_id, title FROM v_entries WHERE title ILIKE '%the%' ORDER BY entry_id DESC LIMIT 500")
def src07(m):
    return m.entries.where(F.col("title").ilike("%the%")).orderBy(F.desc("entry_id")).limit(500).select("entry_id", "title")


@query("ret17_settings", "SELECT id, CASE WHEN id % 5 = 0 THEN 60 ELSE least(200, greatest(5, id % 400)) END AS top_k FROM v_audit")
def ret17(m):
    raw = F.when(F.col("id") % 5 == 0, "many").otherwise((F.col("id") % 400).cast("string"))
    return m.audit.select("id", T.shown(raw, 5, 200, 60).alias("top_k"))
