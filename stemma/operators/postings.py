"""Keyword search for many questions at once by an inverted index of the parts of words.

Words are found wherever they stand, inside longer ones too, so the index has all runs of one to three
characters of an entry. A word can only be in entries of its rarest run; only these are looked at. What
an entry can score at most follows from the index; the most promising entries of each question are read
first, and of the others only those that can still be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import cut, on_workers

#: Characters of a run at most; times the limit of entries that are read first.
RUN, FIRST = 3, 3


def build(entries: DataFrame) -> DataFrame:
    """runs() of entries to be kept as Parquet, sorted by gram: a search reads only the row groups of the runs it asks for."""
    return runs(entries).repartitionByRange("gram", "entry_id").sortWithinPartitions("gram", "entry_id")


def runs(entries: DataFrame) -> DataFrame:
    """(gram, head, entry_id): each run of up to three characters of active entries (entry_id, title, type, text, status), head if it is in title or type.

    Nulls have no runs; texts are whole. An index that one search uses and nobody keeps need not be sorted.
    """
    rows = entries.where("status = 'active'").select(F.col("entry_id").cast("long"), "title", "type", "text")
    names = ["gram", "head", "entry_id"]

    def parts(text: str | None) -> set[str]:
        return {text[i : i + n] for n in range(1, RUN + 1) for i in range(len(text) - n + 1)} if text else set()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, title, kind, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = parts(title) | parts(kind)
                body = parts(text) - head
                flags = pa.array([True] * len(head) + [False] * len(body), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([*head, *body], pa.string()), flags, pa.array([i] * len(flags), pa.int64())], names=names)

    on_workers(entries.sparkSession)
    return rows.mapInArrow(grams, "gram string, head boolean, entry_id long")


def _parts(word: Column) -> Column:
    """The longest runs of a word that the index has."""
    n = F.least(F.length(word), F.lit(RUN))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))


def search(entries: DataFrame, index: DataFrame, questions: DataFrame, limit: int = 12) -> DataFrame:
    """(question_id, r, entry_id, hits): for each question (question_id, tokens) the best entries, as keyword_search() ranks them.

    Each word counts 2 in title or type, else 1 in the text; then page (unknown is 0), then newest id.
    Repeated words of a question count once each time, empty ones find nothing. index is build(entries) or runs(entries).
    """
    asked = cut(questions.select("question_id", F.filter("tokens", lambda t: t.isNotNull() & (t != "")).alias("tokens")))
    words = asked.select(F.explode("tokens").alias("word")).distinct()
    parts = words.select("word", F.explode(_parts(F.col("word"))).alias("gram"))
    postings = cut(index.join(cut(parts.select("gram").distinct()), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a word with a run that no entry has is in none
    rare = parts.join(counts, "gram", "left").groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g"))).alias("gram"))
    held = rare.join(postings, "gram").select("word", "entry_id", F.when(F.col("head"), 2).otherwise(1).alias("most"))
    may = asked.select("question_id", F.explode("tokens").alias("word")).join(held, "word").groupBy("question_id", "entry_id").agg(F.sum("most").alias("most"))
    pages = entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.coalesce("page_no", F.lit(0)).alias("page"))
    may = cut(may.join(pages, "entry_id"))
    order = [F.col("page"), F.desc("entry_id")]
    rank = lambda c: F.row_number().over(W.partitionBy("question_id").orderBy(F.desc(c), *order))

    full = entries.select(F.col("entry_id").cast("long").alias("entry_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "type", "text")))
    one = lambda t: F.when(F.contains("title", t) | F.contains("type", t), 2).when(F.contains("text", t), 1).otherwise(0)
    hits = F.aggregate("tokens", F.lit(0), lambda n, t: n + one(t))

    def read(candidates: DataFrame) -> DataFrame:
        rows = candidates.join(full, "entry_id").join(asked, "question_id")
        return cut(rows.select("question_id", "entry_id", "page", hits.alias("hits")).where("hits > 0"))

    first = cut(may.withColumn("_r", rank("most")).where(F.col("_r") <= FIRST * limit).drop("_r"))
    seen = read(first)
    least = seen.withColumn("_r", rank("hits")).where(F.col("_r") == limit).select("question_id", F.col("hits").alias("_least"))
    rest = may.join(first.select("question_id", "entry_id"), ["question_id", "entry_id"], "left_anti").join(least, "question_id", "left")
    rest = rest.where(F.col("most") >= F.coalesce("_least", F.lit(0))).drop("_least")
    found = seen.unionByName(read(rest)).withColumn("r", rank("hits")).where(F.col("r") <= limit)
    return found.select("question_id", "r", "entry_id", "hits")
