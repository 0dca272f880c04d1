"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's target over the
source's size. The integer part is certain; the fractions are rounded dependently: two documents with
fractions left exchange *words* (the product of fraction and size) in a random direction, such that
neither fraction changes in expectation, until one of them is 0 or 1. A step keeps the source's words
exactly, so a source misses its target by less than one document. Documents meet in small groups of a
source first; the one document that each group leaves undecided goes up a reduction tree of groups of
`FAN`, level by level, until one is left in each source, which is rounded alone.

Only ids, sources and sizes move; groups hold about `GROUP` rows whatever the size of a source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, on_workers

GROUP = 2000
FAN = 64
ROWS = "doc_id long, source string, size long, source_size long, target double, whole long, many long, sure long, part double, grp long, decided boolean"
#: Rows alike are given back in runs of so many.
RUN = 4096


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, n, source_size, target for rows (source, size, many): many rows alike.

    Sources in order of code points, null last, take the weights in turn. Their targets share
    share * all sizes by weight but stop at cap times their own size; what is cut off is shared again.
    Sources that stop are the first ones by size over weight, so one pass over the sources, one row
    each, finds them.
    """
    s = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("many")).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(all_) * share)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("stops", F.col("most") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    # beyond the first source that does not stop, left / weight_left only falls
    level = F.max(F.when(~F.col("stops"), F.col("left") / F.col("weight_left"))).over(all_)
    return s.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(F.least("most", F.col("weight") * level))).select("source", "n", "source_size", "target")


def _pivot(g: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """One group: everything is decided but for one row at most, and that too if last."""
    g = g.sort_values(["doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    part, size = g["part"].to_numpy(float).copy(), g["size"].to_numpy(float)
    open_ = np.flatnonzero((part > 0) & (part < 1) & (size > 0))
    where = g["source"].iloc[0]
    key = [seed, int(g["grp"].iloc[0]), *(where.encode() if isinstance(where, str) else (1, 2, 3))]
    draw = np.random.default_rng(key).random(len(open_) + 1)
    i = None
    for n, j in enumerate(open_):
        if i is None:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1 - part[i]) * a, part[j] * b)  # words that i can take from j
        down = min(part[i] * a, (1 - part[j]) * b)
        if draw[n] * (up + down) < down:
            full, empty = (1 - part[i]) * a <= part[j] * b, part[j] * b <= (1 - part[i]) * a
            part[i], part[j] = 1.0 if full else part[i] + up / a, 0.0 if empty else part[j] - up / b
        else:
            empty, full = part[i] * a <= (1 - part[j]) * b, (1 - part[j]) * b <= part[i] * a
            part[i], part[j] = 0.0 if empty else part[i] - down / a, 1.0 if full else part[j] + down / b
        part[[i, j]] = np.where(part[[i, j]] < 1e-12, 0.0, np.where(part[[i, j]] > 1 - 1e-12, 1.0, part[[i, j]]))
        i = i if 0 < part[i] < 1 else j if 0 < part[j] < 1 else None
    if i is not None and last:
        part[i] = float(draw[-1] < part[i])
    part = np.where(size > 0, part, 0.0)
    g["part"], g["decided"] = part, (part == 0) | (part == 1)
    return g


def _rounder(seed: int, last: bool):
    return lambda g: _pivot(g, seed, last)


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per row of df, the same at every run.

    Sizes are words; a null or empty text has none and is taken 0 times, a null source is a source of
    its own. Rows alike in id (or its absence), source and size are rounded together, as one row whose
    copies are dealt out to them; which of them is taken once more than the others is undefined. So no
    key makes a group large. An empty table gives none. Only the three named columns are read.
    """
    on_workers(df.sparkSession)
    sized = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    alike = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("many")))
    goal = targets(alike, weights, share, cap)
    rows = alike.join(goal, alike["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = F.ceil(F.col("n") / GROUP)
    rows = rows.withColumn("whole", F.floor(rate).cast("long")).withColumn("all_parts", F.col("many") * (rate - F.col("whole"))).withColumn("sure", F.floor("all_parts").cast("long"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "many", "sure", (F.col("all_parts") - F.col("sure")).alias("part"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), groups).cast("long").alias("grp"), F.lit(False).alias("decided"))
    most = goal.agg(F.max("n")).first()[0] or 0
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(most / GROUP)), FAN) - 1e-9))
    done: list[DataFrame] = []
    for level in range(levels + 1):
        rows = cut(rows.groupBy("source", "grp").applyInPandas(_rounder(seed + level, level == levels), ROWS))
        done.append(rows.where("decided"))
        rows = rows.where("not decided").withColumn("grp", F.expr(f"grp div {FAN}"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # one row for each of those alike, in two steps: no array grows with their number
    out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / RUN))))
    out = out.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("many"), (F.col("run") + 1) * RUN) - 1)))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("nth") < F.col("sure") + F.col("part").cast("long")).cast("long")).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_rows(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows, each as often as its own row of mix(df) is taken; ids may be null or repeated.

    Rows alike in id, source and size have as many rows in the mix, and those differ by one copy at most:
    the first ones by a hash of their text take the lower number, the others the higher one.
    """
    key = ["_mix_id", "_mix_id_null", "_mix_source", "_mix_source_null", "_mix_size"]

    def keyed(rows: DataFrame, id_: Column, source: Column, size: Column) -> DataFrame:
        # nulls as values, so that plain equality joins them
        parts = (F.coalesce(id_, F.lit(0)), id_.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size)
        return rows.withColumns(dict(zip(key, parts, strict=True)))

    taken = keyed(mixed, F.col("doc_id"), F.col("source"), F.col("size")).groupBy(*key).agg(F.min("copies").alias("_low"), F.max("copies").alias("_high"), F.count("*").alias("_n"), F.sum("copies").alias("_sum")).where("_high > 0")
    taken = taken.select(*key, "_low", "_high", (F.col("_n") - (F.col("_sum") - F.col("_n") * F.col("_low"))).alias("_lows"))
    docs = keyed(df, df[id_col].cast("long"), df[source_col].cast("string"), word_count(df[text_col])).where("_mix_size > 0")
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(F.lit("nth"), F.col(text_col))))
    copies = F.when(F.col("_nth") <= F.col("_lows"), F.col("_low")).otherwise(F.col("_high"))
    rows = docs.withColumn("_nth", nth).join(taken, key).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return rows.select(*df.columns)
