"""The kinship and document model as views over the star-schema tables.

Each body is plain SQL that Spark and DuckDB both run: {D} is integer division, {S} the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS: dict[str, str] = {
    "v_lineages": "SELECT r_regionkey AS lineage_id, r_name AS name, concat('R', CAST(100 + r_regionkey AS {S}), '-001-001') AS code FROM region",
    "v_branches": "SELECT n_nationkey AS branch_id, n_regionkey AS lineage_id, n_name AS name FROM nation",
    "v_persons": "SELECT c_custkey AS person_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 <= 2 THEN 'female' ELSE 'male' END AS gender, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1800 + c_custkey % 150 END AS birth_year, c_mktsegment AS birth_place, c_custkey % 12 + 1 AS generation FROM customer",
    "v_in_branch": "SELECT c_custkey AS person_id, c_nationkey AS branch_id FROM customer WHERE c_custkey % 11 <> 0",
    "v_belongs_to": "SELECT c.c_custkey AS person_id, n.n_regionkey AS lineage_id FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_custkey % 11 = 0 OR c.c_custkey % 4 = 0",
    "v_parent_of": "SELECT (c_custkey - 1) {D} 3 AS src, c_custkey AS dst FROM customer WHERE c_custkey >= 1 UNION ALL SELECT (c_custkey - 1) {D} 3 + 1 AS src, c_custkey AS dst FROM customer WHERE c_custkey >= 2 AND c_custkey % 2 = 0",
    "v_spouse_of": "SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 4 = 1",
    "v_entries": "SELECT doc_id AS entry_id, doc_id % 5 AS lineage_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 25 END AS branch_id, source AS type, substring(text, 1, 40) AS title, text, doc_id % 50 AS page_no, CASE WHEN doc_id % 10 = 9 THEN 'archived' ELSE 'active' END AS status FROM documents",
    "v_vectors": "SELECT vec_id AS entry_id, vec_id % 5 AS lineage_id, embedding AS vector FROM embeddings",
    "v_pages": "SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS page_no, l_partkey AS part_id, l_suppkey AS person_id, l_returnflag = 'R' AS failed, l_linestatus = 'F' AS reviewed, round(l_discount * 10, 2) AS confidence FROM lineitem",
    "v_tasks": "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_custkey AS created_by, o_orderdate AS created_at, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate END AS archived_at, o_totalprice AS file_size, o_orderpriority AS file_name FROM orders",
    "v_audit": "SELECT event_id AS id, user_id, event_type AS action, props AS detail, ts AS created_at, value FROM events",
    "v_dup_persons": "SELECT p_partkey AS person_id, p_name AS name, p_brand AS branch_name, p_size AS birth_year FROM part",
    "v_users": "SELECT s_suppkey AS id, s_name AS username, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN concat('User ', CAST(s_suppkey AS {S})) END AS full_name, CASE WHEN s_suppkey % 4 = 0 THEN 'admin' WHEN s_suppkey % 4 = 1 THEN 'editor' ELSE 'viewer' END AS role FROM supplier",
}


class Model:
    """The views of one data folder; attributes are DataFrames, read when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        body = VIEWS[f"v_{name}"].replace("{D}", "div").replace("{S}", "STRING")
        for t in TABLES:
            body = body.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in body}
        return self.spark.sql(body, **used)


def oracle(sql: str) -> str:
    """sql for DuckDB, with the views that it names before it."""
    used = [v for v in VIEWS if v in sql]
    views = ", ".join(f"{v} AS ({VIEWS[v].replace('{D}', '//').replace('{S}', 'VARCHAR')})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {body[len('WITH RECURSIVE') :]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views}, {body[len('WITH') :]}"
    return f"WITH {views} {body}"
