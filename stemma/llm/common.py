"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table below the reliable checkpoint folder and go on from there.

    Unlike a checkpoint, a table is compressed, and what follows reads only the columns it needs. The folder
    is the cluster's (`spark.checkpoint.dir`); one of our own is set only where none is configured, as in
    local tests. Tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own_folder(sc.master))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, sc, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(sc, path: str) -> None:
    if sc._jsc is not None:  # else the session has ended before, and its folders are the cluster's to clear
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def own_folder(master: str) -> str:
    """A temporary folder of this machine, which is only good where the driver runs all tasks itself."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stemma-checkpoint-")


def join_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join whose two sides are shuffled for it alone, whatever they were dealt by before.

    Spark splits the rows of a frequent key only between plain shuffles, not where a side comes straight
    from an aggregation by the same keys. A hash as a further key makes both sides plain.
    """
    left, right = (df.withColumn("_anew", F.xxhash64(*keys)) for df in (left, right))
    return left.join(right, ["_anew", *keys], how).drop("_anew")


def by_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What f makes of the rows of each group, which are held together.

    Groups are dealt out by their keys (numbers, never null) and come in order, many to an Arrow batch:
    where there are very many small ones, this takes less time and memory than a batch for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, done = None, []

        def finish() -> None:
            if held:
                done.append(f(pa.Table.from_batches(held)))
                held.clear()

        def ready() -> Iterator[pa.RecordBatch]:
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done.clear()

        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
            for start, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                now = tuple(c[start] for c in columns)
                if now != key:
                    finish()
                    key = now
                held.append(b.slice(start, end - start))
            yield from ready()
        finish()
        yield from ready()

    on_workers(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def pieces(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Texts in runs of about so many characters: what is made of them at once stays small."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads; whatever else df has, under any name, stays out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
