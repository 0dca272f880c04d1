"""Samples of counters and of progress as streams with state of their own: rings of samples that expire, time left.

Both need the state store of RocksDB, see use_rocksdb(). State is per key and bounded: a ring holds as many
samples as it keeps, a stage its first and last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams that are started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000)


class _Ring(StatefulProcessor):
    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "us long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        out = []
        for _, r in pd.concat(list(rows)).sort_values(["at", "value"], kind="stable").iterrows():
            us, value = _micros(r["at"]), float(r["value"])
            if held and us <= held[-1][0]:
                continue
            if held and us - held[-1][0] > self.idle * 1000:
                held = []
            rate = max(0.0, value - held[-1][1]) / ((us - held[-1][0]) / 1e6) if held else None
            held = [*held, (us, value)][-self.keep :]
            out.append((r["at"], value, rate, len(held), min(v for _, v in held), max(v for _, v in held)))
        if out:
            self.ring.put(held)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(held[-1][0] // 1000 + self.idle)
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "at": pd.Series(columns[0], dtype="datetime64[ns]"), "value": pd.Series(columns[1], dtype=float), "rate": pd.Series(columns[2], dtype=float), "n": pd.Series(columns[3], dtype="int64"), "low": pd.Series(columns[4], dtype=float), "high": pd.Series(columns[5], dtype=float)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rings(samples: DataFrame, keep: int = 60, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, at, value, rate, n, low, high) for each sample (key, at, value) of a stream, in order of time.

    rate is the change per second since the sample before, 0 where the counter fell, null for a key's
    first; n, low and high are of the ring of the last `keep` samples, this one included. A sample that is
    not later than the last one is skipped. A key that is idle for longer, by the samples' own time, is
    forgotten, and its next sample is a first one again; its state goes when the watermark gets there.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = samples.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value")).where("at is not null and value is not null")
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Ring(keep, ms), "key string, at timestamp, value double, rate double, n long, low double, high double", "Append", "EventTime")


class _Left(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "us long, done long")
        self.last = handle.getValueState("last", "us long, done long, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = [(_micros(r["at"]), int(r["done"]), int(r["total"])) for _, r in pd.concat(list(rows)).iterrows()]
        a = min([(us, done) for us, done, _ in own] + ([tuple(self.first.get())] if self.first.exists() else []))
        b = max(own + ([tuple(self.last.get())] if self.last.exists() else []))
        self.first.update(a)
        self.last.update(b)
        pages = b[1] - a[1]
        left = (b[0] - a[0]) / 1e6 / pages * max(0, b[2] - b[1]) if pages > 0 else None
        yield pd.DataFrame({"task_id": [key[0]], "stage": [key[1]], "at": pd.Series([pd.Timestamp(b[0] * 1000)], dtype="datetime64[ns]"), "seconds_left": pd.Series([left], dtype=float)})

    def close(self) -> None:
        pass


def times_left(progress: DataFrame) -> DataFrame:
    """(task_id, stage, at, seconds_left) whenever progress (task_id, stage, at, done, total) arrives: mean seconds a page since the stage's first sample, times the pages that are left; null before a page is done."""
    rows = progress.select(F.col("task_id").cast("long"), F.col("stage").cast("string"), F.col("at").cast("timestamp"), F.col("done").cast("long"), F.col("total").cast("long")).na.drop()
    return rows.groupBy("task_id", "stage").transformWithStateInPandas(_Left(), "task_id long, stage string, at timestamp, seconds_left double", "Append", "None")
