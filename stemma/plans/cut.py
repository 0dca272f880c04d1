"""Cutting the lineage of iterated plans, and what Python workers need."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def _own_folder(master: str) -> str:
    """A temporary folder of this machine, which is only good where the driver runs all tasks itself."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stemma-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """df written as a table below the reliable checkpoint folder and read again: a plan that begins anew.

    Unlike a checkpoint, which makes its rows twice, a table is written once, and what follows reads only
    the columns it needs. The folder is the cluster's (`spark.checkpoint.dir`), or in a local session one
    of our own where none is set. Tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or _own_folder(sc.master))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, sc, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that spread() makes.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys for a step that handles so many rows in all, into as many partitions as have ROWS each.

    Spark puts partitions together until they have 64 MB, as written down and compressed: where rows
    compress well, or become many in the step, a task gets more of them with each further row of the table.
    """
    n = math.ceil(rows / ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def _remove(sc, path: str) -> None:
    if sc._jsc is not None:  # else the session has ended before, and its folders are the cluster's to clear
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
