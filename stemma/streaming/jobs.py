"""Streaming forms of operators whose inputs arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counter_rates(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Change of each counter per second between its samples, 0 where it fell; the first sample of a key gives none.

    Each key keeps its last sample only. Samples of a micro-batch are taken in order of time; one that is
    older than the last is skipped.
    """
    schema = f"{key} string, {at} timestamp, rate double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([at, value], kind="stable")
        last = state.get if state.exists else None
        out = []
        for t, v in zip(rows[at], rows[value], strict=True):
            us = int(t.value // 1000)
            if last is not None and us > last[0]:
                out.append((k[0], t, max(0.0, float(v) - last[1]) / ((us - last[0]) / 1e6)))
            if last is None or us > last[0]:
                last = (us, float(v))
        if last is not None:
            state.update(last)
        yield pd.DataFrame({key: pd.Series([o[0] for o in out], dtype=object), at: pd.Series([o[1] for o in out], dtype="datetime64[ns]"), "rate": pd.Series([o[2] for o in out], dtype=float)})

    return samples.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, schema, "us long, value double", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, at: str, key: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by key and window; windows are given once they are closed."""
    counted = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, every), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "total")


def latest_states(events: DataFrame) -> DataFrame:
    """Status of each task from its events (task_id, at, event) as they arrive, one row for each change.

    A pause holds until a resume; done and failed are final unless restarted. A task's events within a
    micro-batch are taken in order.
    """
    to = {"pending": {"start": "running", "pause": "paused", "finish": "done", "error": "failed"}, "running": {"pause": "paused", "finish": "done", "error": "failed"}, "paused": {"resume": "running"}, "done": {}, "failed": {}}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = before = state.get[0] if state.exists else "pending"
        for e in pd.concat(list(batches)).sort_values("at", kind="stable")["event"]:
            now = "running" if e == "restart" else to[now].get(e, now)
        if now != before or not state.exists:
            state.update((now,))
            yield pd.DataFrame({"task_id": [k[0]], "status": [now]})

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id long, status string", "status string", "append", GroupStateTimeout.NoTimeout)


def index_entries(entries: DataFrame, index_path: str, embed, checkpoint: str, parts: int = 16):
    """Keep a vector table in step with a stream of entries (entry_id, updated_at, status, title, text).

    The index is dealt into `parts` folders by a hash of the id. Each micro-batch takes the newest row of each
    entry, embeds the active ones, and writes anew only the parts that it touches: its entries leave, active
    ones come back. A part has its versions by number of batch; the one before stays until the next batch,
    so a batch that is run again after a loss finds what it read, and older ones are deleted.
    """
    from pyspark.sql import Window as W

    part = F.pmod(F.xxhash64("entry_id"), F.lit(parts)).cast("int").alias("part")

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("r", F.row_number().over(W.partitionBy("entry_id").orderBy(F.desc("updated_at"), "status"))).where("r = 1").drop("r").persist()
        touched = [r[0] for r in newest.select(part).distinct().collect()]  # parts at most
        fresh = embed(newest.where("status = 'active'")).select("*", part)
        spark = batch.sparkSession
        versions = index_versions(spark, index_path)
        before = {p: max(v for v in found if v < number) for p, found in versions.items() if p in touched and any(v < number for v in found)}
        if before:
            old = spark.read.schema(fresh.drop("part").schema).parquet(*(f"{index_path}/part={p}/v={v}" for p, v in before.items()))
            fresh = old.select("*", part).join(newest.select("entry_id"), "entry_id", "left_anti").unionByName(fresh)
        out = fresh.withColumn("v", F.lit(number)).repartition("part")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(index_path)
        newest.unpersist()
        fs = _folder(spark, index_path).getFileSystem(spark._jsc.hadoopConfiguration())
        for p in touched:  # a part that has lost all its rows has a version too
            fs.mkdirs(_folder(spark, f"{index_path}/part={p}/v={number}"))
        for p, v in ((p, v) for p, found in versions.items() for v in found if p in before and v < before[p]):
            fs.delete(_folder(spark, f"{index_path}/part={p}/v={v}"), True)

    return entries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def index_versions(spark: SparkSession, index_path: str) -> dict[int, list[int]]:
    """Versions of each part of an index, by the names of its folders."""
    top = _folder(spark, index_path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for p in fs.listStatus(top) if fs.exists(top) else ():
        name = p.getPath().getName()
        if name.startswith("part="):
            out[int(name[5:])] = sorted(int(v.getPath().getName()[2:]) for v in fs.listStatus(p.getPath()) if v.getPath().getName().startswith("v="))
    return out


def read_index(spark: SparkSession, index_path: str, schema) -> DataFrame:
    """The newest version of every part; schema is that of its rows."""
    paths = [f"{index_path}/part={p}/v={v[-1]}" for p, v in sorted(index_versions(spark, index_path).items()) if v]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
