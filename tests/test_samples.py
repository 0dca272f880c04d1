"""Streams of samples against the same rows at once, and state that expires."""

import random
from datetime import datetime, timedelta

import pytest

from stemma.operators import tables as T
from stemma.plans.cut import on_workers
from stemma.streaming import samples as S

START = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    on_workers(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)

    def run(batches, ddl, f):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "b*"))
        query = f(source).writeStream.format("memory").queryName("samples").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        run.state_rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return spark.table("samples").collect()

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_rings_like_a_batch(spark, stream):
    r = random.Random(3)
    rows, at = [], {}
    for _ in range(240):
        k = r.choice("abc")
        at[k] = at.get(k, START) + timedelta(seconds=r.choice((1, 5, 30)))
        rows.append((k, at[k], float(r.randrange(100))))
    batches = [rows[:80], rows[80:90] + [("a", START, 5.0)], rows[90:]]
    got = {(x.key, x.at): x for x in stream(batches, "key string, at timestamp, value double", lambda s: S.rings(s, keep=10))}
    whole = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, key string, at timestamp, value double")
    want = {(x["key"], x["at"]): x["rate"] for x in T.rates(whole, "key", "at", "value").collect()}
    assert {k: None if x.rate != x.rate else x.rate for k, x in got.items()} == pytest.approx(want)
    last = {(x["key"], x["at"]): x["value"] for x in T.last_samples(whole, "key", "at", 10).collect()}
    for k in "abc":
        end = got[k, at[k]]
        own = [v for (key, _), v in last.items() if key == k]
        assert (end.n, end.low, end.high) == (10, min(own), max(own))


def test_idle_keys_are_forgotten(stream):
    hour = timedelta(hours=1)
    batches = [[("a", START, 1.0), ("b", START, 1.0)], [("a", START + 2 * hour, 2.0)], [("a", START + 3 * hour, 3.0)], [("a", START + 3.5 * hour, 4.0), ("b", START + 3.5 * hour, 9.0)]]
    got = {(x.key, x.at): (None if x.rate != x.rate else x.rate, x.n) for x in stream(batches, "key string, at timestamp, value double", lambda s: S.rings(s, idle="150 minutes", late="1 minute"))}
    assert got["b", START + 3.5 * hour] == (None, 1)
    assert got["a", START + 3.5 * hour][1] == 4 and got["a", START + 2 * hour][0] == pytest.approx(1 / 7200)


def test_idle_state_goes(stream):
    batches = [[(k, START, 1.0) for k in "abcdefgh"], *([("a", START + timedelta(hours=h), 2.0)] for h in (5, 6, 7))]
    stream(batches, "key string, at timestamp, value double", lambda s: S.rings(s, idle="1 hour", late="1 minute"))
    assert stream.state_rows[-1] < stream.state_rows[0] / 4


def test_time_left_like_a_batch(spark, stream):
    r = random.Random(4)
    rows = [(t, s, START + timedelta(seconds=10 * k + t), min(50, k * (t % 3)), 50) for k in range(30) for t in range(5) for s in ("extract", "convert") if r.random() < 0.7]
    ddl = "task_id long, stage string, at timestamp, done long, total long"
    got = {}
    for x in stream([rows[:60], rows[60:100], rows[100:]], ddl, S.times_left):
        if (x.task_id, x.stage) not in got or x["at"] >= got[x.task_id, x.stage]["at"]:
            got[x.task_id, x.stage] = x
    want = {(x.task_id, x.stage): x.seconds_left for x in T.time_left(spark.createDataFrame(rows, ddl)).collect()}
    assert {k: None if x.seconds_left != x.seconds_left else x.seconds_left for k, x in got.items()} == pytest.approx(want)
