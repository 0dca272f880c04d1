"""Readings with several ways to read a character, and the index of their beginnings."""

import pytest

from stemma.operators import readings as L
from stemma.plans import cut


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a1", "never", 0), ("张", "Zhang", 0), ("单", "dan", 1), ("单", "shan", 0), ("单", "shan", 2), ("行", "hang", 1), ("行", "xing", 0), ("空", "", 0)]
    return spark.createDataFrame(rows, "char string, reading string, ord int").withColumn("text", table_clash())


def table_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_all_ways(spark, table):
    texts = spark.createDataFrame([("张 单",), ("行单",), ("行单",), ("李空x",), ("é1",), ("",), (None,)], "text string")
    got = {r.text: (r.full, r.initials) for r in L.readings_of(texts, table).collect()}
    assert got == {
        "张 单": (["zhangshan", "zhangdan"], ["zs", "zd"]),
        "行单": (["xingshan", "xingdan", "hangshan", "hangdan"], ["xs", "xd", "hs", "hd"]),
        "李空x": (["李空"], ["李空"]),
        "é1": ([], []),
    }


def test_combinations_are_bounded(spark, table):
    text = "行" * 12
    row = L.readings_of(spark.createDataFrame([(text,)], "text string"), table).first()
    assert len(row.full) == L.COMBINATIONS and row.full[0] == "xing" * 12 and all(x.endswith("xing" * 4) for x in row.full)


def test_index_is_pruned(spark, table, tmp_path, capsys):
    people = spark.createDataFrame([(1, "张单"), (2, "行单"), (3, "Zhang"), (4, None), (5, "单行"), (6, "张单")], "person_id long, name string")
    L.reading_index(people, table).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    ask = lambda q: sorted(r.person_id for r in L.begun(index, q).collect())
    assert ask("zhangs") == [1, 6] and ask(" ZD ") == [1, 6] and ask("d") == [5] and ask("h") == [2] and ask("q") == [] and ask("shanh") == [5]
    L.begun(index, "zh").explain("formatted")
    assert "GreaterThanOrEqual(reading,zh)" in capsys.readouterr().out


def test_no_rows(spark, table):
    none = spark.createDataFrame([], "text string")
    assert L.readings_of(none, table).count() == 0
    assert L.fitted(spark.createDataFrame([], "query string, name string"), table).count() == 0
    pairs = spark.createDataFrame([(None, "张"), ("张", None), ("é", "ü")], "query string, name string")
    assert [r.score for r in L.fitted(pairs, L.no_readings(pairs)).collect()] == [None, None, None]


def test_no_own_folder_on_a_cluster():
    with pytest.raises(ValueError):
        cut._own_folder("spark://host:7077")
