"""Every registered query that has SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stemma.plans import apply_queries, graph_queries, name_queries, registry, rule_queries, table_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(x[names.index(c)]) for c in columns]) for x in r.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
