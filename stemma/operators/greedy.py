"""Greedy cuts of sequences, long ones in parallel.

Groups of up to `SMALL` rows are gone through row by row, many groups in a task. In longer ones, where a
batch ends depends on where it begins, and that on all before it. But where a batch would end if
it began at a row follows from sums up to each row alone, so every row knows which one would begin the
next batch. The rows that really begin one are those on the path from the first row; they are found by
doubling these pointers. Sums are made by ranges of rows with what the ranges before them add up to, so
one group may be spread over all tasks. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import cut, on_workers

#: Rows of a group that one task goes through.
SMALL = 200_000


def folded(df: DataFrame, keys: list[str], order: list[str], schema: str, begin: Callable[[tuple], tuple[Callable[[tuple], Iterable[tuple]], Callable[[], Iterable[tuple]]]]) -> DataFrame:
    """What a fold makes of each group's rows in order: begin(key) gives step(row) and end(), which yield rows of schema.

    Groups are dealt out by key and read in order, many to a batch; rows pass by one at a time.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step, end = None, None, tuple
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b[c].tolist() for c in names), strict=True):
                k = tuple(row[i] for i in at)
                if k != key:
                    out += end()
                    key = k
                    step, end = begin(k)
                out += step(row)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(list(end()), columns=columns)

    on_workers(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def by_length(df: DataFrame, keys: list[str], short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """short of the groups of up to SMALL rows and long of the others."""
    large = cut(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*keys))
    if large.isEmpty():
        return short(df)
    return short(df.join(large, keys, "left_anti")).unionByName(long(df.join(large, keys, "left_semi")))


def running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with n, the row's number in its group from 1 on, and total, the sum of value up to and with it. Keys are never null; a null value is 0."""
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = placed.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum(F.coalesce(value, F.lit(0))).over(w).cast("long")})
    parts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.sum(F.coalesce(value, F.lit(0))).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # only the first group of a range can have begun in another one: a row for each range at most
    offsets = parts.select("_part", *keys, F.sum("_n").over(before).alias("_n"), F.sum("_sum").over(before).alias("_sum")).where("_n is not null")
    out = own.join(F.broadcast(offsets), ["_part", *keys], "left")
    return out.select(*df.columns, (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("_sum", F.lit(0))).cast("long").alias("total"))


def _reach(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, end) for rows (keys, n, total, cost): the last row that a batch from row n holds, if it costs `most` at most; itself at least.

    Sums are dealt to buckets as wide as `most`: the last sum within reach is in the bucket of the limit or the one before it.
    """
    limit = F.col("total") - F.col("cost") + most
    sums = rows.select(*keys, F.floor(F.col("total") / most).alias("bucket"), F.col("total").alias("value"), F.lit(0).alias("kind"), "n")
    asked = rows.select(*keys, F.floor(limit / most).alias("bucket"), limit.alias("value"), F.lit(1).alias("kind"), "n")
    w = W.partitionBy(*keys, "bucket").orderBy("value", "kind", "n").rowsBetween(W.unboundedPreceding, 0)
    near = sums.unionByName(asked).withColumn("end", F.max(F.when(F.col("kind") == 0, F.col("n"))).over(w)).where("kind = 1")
    whole = sums.groupBy(*keys, (F.col("bucket") + 1).alias("bucket")).agg(F.max("n").alias("_before"))
    return near.join(whole, [*keys, "bucket"], "left").select(*keys, "n", F.greatest("n", "end", "_before").alias("end"))


def begun(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the rows on the path from row 1 of each group; pointers (keys, n, to) lead onwards or are null."""
    most = pointers.agg(F.max("n")).first()[0]
    if not most:
        return pointers.select(*keys, "n")
    jumps = [cut(pointers.where("to is not null").select(*keys, "n", "to"))]
    for _ in range(math.ceil(math.log2(most + 1)) - 1):
        last = jumps[-1]
        jumps.append(cut(last.join(last.select(*keys, F.col("n").alias("to"), F.col("to").alias("_to")), [*keys, "to"]).select(*keys, "n", F.col("_to").alias("to"))))
        if jumps[-1].isEmpty():
            jumps.pop()
            break
    marked = pointers.where("n = 1").select(*keys, "n")
    for jump in reversed(jumps):
        marked = cut(marked.unionByName(marked.join(jump, [*keys, "n"]).select(*keys, F.col("to").alias("n"))).distinct())
    return marked


def batched(items: DataFrame, keys: list[str], order: list[str], cost: str, most_items: int | None, most_cost: int) -> DataFrame:
    """items with the number of the batch they fall into: in order, a batch ends before it has too many items or costs too much.

    An item that costs too much is a batch by itself; costs are whole numbers from 0 on, null is 0. Keys
    are never null, and order tells the rows of a group apart.
    """
    named = [*keys, *order]
    slim = items.select(*named, F.coalesce(cost, F.lit(0)).cast("long").alias("_cost"))
    kinds = dict(slim.dtypes)

    def begin(key: tuple):
        batch, n, size = 0, 0, 0

        def step(row: tuple) -> Iterator[tuple]:
            nonlocal batch, n, size
            if n and (most_items is not None and n + 1 > most_items or size + row[-1] > most_cost):
                batch, n, size = batch + 1, 0, 0
            n, size = n + 1, size + row[-1]
            yield (*row[:-1], batch)

        return step, tuple

    short = lambda df: folded(df, keys, order, ", ".join(f"{c} {kinds[c]}" for c in named) + ", batch int", begin)
    found = by_length(slim, keys, short, lambda df: _batched(df, keys, order, most_items, most_cost))
    return items.join(found, named).select(*items.columns, "batch")


def _batched(slim: DataFrame, keys: list[str], order: list[str], most_items: int | None, most_cost: int) -> DataFrame:
    rows = cut(running(slim, keys, order, "_cost"))
    end = _reach(rows.select(*keys, "n", "total", F.col("_cost").alias("cost")), keys, most_cost)
    if most_items is not None:
        end = end.withColumn("end", F.least("end", F.col("n") + most_items - 1))
    size = rows.groupBy(*keys).agg(F.max("n").alias("_last"))
    after = F.col("end") + 1
    starts = begun(cut(end.join(size, keys).select(*keys, "n", F.when(after <= F.col("_last"), after).alias("to"))), keys)
    flagged = rows.join(starts.withColumn("_start", F.lit(1).cast("long")), [*keys, "n"], "left").drop("n", "total", "_cost")
    return running(flagged, keys, order, "_start").select(*keys, *order, (F.col("total") - 1).cast("int").alias("batch"))


def chunked(pages: DataFrame, budget: int = 2000, overlap: int = 2) -> DataFrame:
    """(task_id, chunk, first, last): pages (task_id, page_no, size) in chunks of at most budget characters.

    A chunk begins `overlap` pages before the last one's end, unless that chunk had no more pages than
    that: every chunk begins after the one before it. A page over the budget is a chunk by itself. Page
    numbers tell the pages of a task apart.
    """

    def begin(key: tuple):
        held: list[tuple[int, int]] = []  # pages and sizes of the chunk so far
        chunk, total = 0, 0

        def close() -> tuple:
            nonlocal chunk, total
            out = (key[0], chunk, held[0][0], held[-1][0])
            chunk += 1
            del held[: len(held) - overlap if len(held) > overlap else len(held)]
            total = sum(x[1] for x in held)
            return out

        def step(row: tuple) -> Iterator[tuple]:
            nonlocal total
            waiting = [(row[1], row[2])]
            while waiting:
                if not held or total + waiting[0][1] <= budget:
                    held.append(waiting.pop(0))
                    total += held[-1][1]
                    continue
                yield close()
                # pages that the next chunk shares with this one are put again one by one: they may be too much together
                waiting[:0] = held
                held.clear()
                total = 0

        def end() -> Iterator[tuple]:
            if held:
                yield close()

        return step, end

    slim = pages.select(F.col("task_id").cast("long").alias("task_id"), F.col("page_no").cast("long").alias("page_no"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    short = lambda df: folded(df, ["task_id"], ["page_no"], "task_id long, chunk int, first long, last long", begin)
    return by_length(slim, ["task_id"], short, lambda df: _chunked(df, budget, overlap))


def _chunked(slim: DataFrame, budget: int, overlap: int) -> DataFrame:
    keys = ["task_id"]
    rows = cut(running(slim, keys, ["page_no"], "size"))
    end = cut(_reach(rows.select("task_id", "n", "total", F.col("size").alias("cost")), keys, budget))
    size = rows.groupBy("task_id").agg(F.max("n").alias("_last"))
    after: Column = F.when(F.col("end") - F.col("n") + 1 > overlap, F.col("end") + 1 - overlap).otherwise(F.col("end") + 1)
    starts = begun(cut(end.join(size, keys).select("task_id", "n", F.when(F.col("end") < F.col("_last"), after).alias("to"))), keys)
    found = starts.join(end, ["task_id", "n"]).select("task_id", F.col("n").alias("start"), "end")
    place = rows.select("task_id", "n", "page_no")
    found = found.join(place.select("task_id", F.col("n").alias("start"), F.col("page_no").alias("first")), ["task_id", "start"]).join(place.select("task_id", F.col("n").alias("end"), F.col("page_no").alias("last")), ["task_id", "end"])
    numbered = running(found.withColumn("_one", F.lit(1)), keys, ["start"], "_one")
    return numbered.select("task_id", (F.col("n") - 1).cast("int").alias("chunk"), "first", "last")
