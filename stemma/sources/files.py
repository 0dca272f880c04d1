"""Scan files and their pages."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENDINGS = ("pdf", "tif", "tiff", "png", "jpg", "jpeg", "bmp", "webp")


def accepted(name: Column) -> Column:
    """Whether a file's name ends as a scan's."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*ENDINGS)


def scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan files below a folder: path, name, file_size, modified, file_sha256; empty files and other endings are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(accepted(F.col("path")) & (F.col("length") > 0))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_sha256"))


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Objects below a folder whose name, as a path from there, begins with prefix: name, size, modified; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", rf"\Q{path.rstrip('/')}\E/(.*)$", 1)
    return rows.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("name").startswith(prefix))


def recovered_pages(objects: DataFrame) -> DataFrame:
    """(task_id, page_no, name) of page images by their object names."""
    page = F.nullif(F.regexp_extract("name", r"page_(\d+)\.png$", 1), F.lit("")).cast("int")
    return objects.select(F.regexp_extract("name", r"^scans/([^/]+)/", 1).alias("task_id"), page.alias("page_no"), "name").where("page_no is not null and task_id <> ''")


_PDF_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_PDF_COUNT = re.compile(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b")


def page_total(content: bytes) -> int:
    """Pages of a scan by its headers alone: of a PDF the page tree's count, of a TIFF its chain of directories, else 1; 0 for nothing or a broken file."""
    if content[:5] == b"%PDF-":
        counts = [int(a or b) for a, b in _PDF_COUNT.findall(content)]
        return max(counts, default=len(_PDF_PAGE.findall(content)))
    if content[:4] in (b"II*\0", b"MM\0*"):
        order, seen = "<" if content[:1] == b"I" else ">", set()
        try:
            at = struct.unpack_from(order + "I", content, 4)[0]
            while at and at not in seen:
                seen.add(at)
                entries = struct.unpack_from(order + "H", content, at)[0]
                at = struct.unpack_from(order + "I", content, at + 2 + 12 * entries)[0]
        except struct.error:
            return max(0, len(seen) - 1)
        return len(seen)
    return int(len(content) > 0)


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, total) of the scan files below a folder; contents stay where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "total": b["content"].map(page_total).astype("int64")})

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where(accepted(F.col("path"))).select("path", "content").mapInPandas(run, "path string, total long")


def page_rows(tasks: DataFrame, total: Column) -> DataFrame:
    """One row for each page of each task, numbered from 1."""
    return tasks.where(total > 0).withColumn("page_no", F.explode(F.sequence(F.lit(1), total.cast("int"))))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to a Parquet table, dealt out by day."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def overwrite_tasks(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the tasks in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)
