"""Buckets of sets that agree on a key: which pairs to try, and how large buckets are finished, whatever their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_anew


def met(keys: DataFrame) -> DataFrame:
    """Rows (rep, n, value) whose value occurs more than once, with its count m and its smallest rep as first."""
    many = keys.groupBy("value").agg(F.count("*").alias("m"), F.min("rep").alias("first")).where("m > 1")
    return cut(join_anew(keys, many, ["value"]))


def neighbours(members: DataFrame, small: int, near: int, lot: int, blocks: Column | None = None) -> DataFrame:
    """Pairs (a < b) of members of a bucket: all of up to `small` ones.

    A larger bucket is dealt into lots of about `lot` members; each is paired with the next `near - 1` of
    its lot, and the first of its lot and of its bucket.
    """
    dealt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / lot)).cast("int")
    by = W.partitionBy("value", "lot").orderBy("rep")
    other = lambda x: F.struct(x("rep").alias("rep"), x("n").alias("n"))
    ahead = [F.when((F.col("m") <= small) | F.lit(j < near), other(lambda c, j=j: F.lead(c, j).over(by))) for j in range(1, max(small, near))]
    firsts = [other(lambda c: F.first(c).over(by)), F.struct(F.col("first").alias("rep"), F.col("n").alias("n"))]
    partners = F.filter(F.array(*ahead, *firsts), lambda x: x["rep"].isNotNull() & (x["rep"] != F.col("rep")))
    reach = members.withColumn("lot", dealt).withColumn("to", partners).select("rep", "n", "m", F.explode("to").alias("o")).withColumn("most", F.greatest("n", "o.n"))
    pairs = reach.select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b"), (F.lit(1) if blocks is None else blocks).alias("blocks"))
    return pairs.groupBy("a", "b").agg(F.max("blocks").alias("blocks"))


def between(members: DataFrame, found: DataFrame, blocks) -> DataFrame:
    """Who is still to be compared: (first, i, j, few, rep, label) for each block (first, i, j) that it is in.

    Buckets with the same first member form a group, if they are not in one component (found: id,
    component; label). Of a group, members outside its largest component (few) meet all members in blocks:
    as many as blocks(count, sum of n) says for each side.
    """
    open_ = members.join(found, members["rep"] == found["id"], "left").select("rep", "n", "value", "first", F.coalesce("component", "rep").alias("label"))
    split = open_.groupBy("value").agg((F.min("label") < F.max("label")).alias("split")).where("split").drop("split")
    sets = cut(join_anew(open_, split, ["value"]).select("first", "rep", "n", "label").distinct())
    main = sets.groupBy("first", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("first")
    main = main.agg(F.sum("c").alias("all"), F.sum("s").alias("size"), F.max_by(F.struct("label", "c", "s"), F.struct("c", "label")).alias("main"))
    main = main.select("first", F.col("main.label").alias("main"), blocks(F.col("all"), F.col("size")).alias("nj"), blocks(F.col("all") - F.col("main.c"), F.col("size") - F.col("main.s")).alias("ni"))
    sets = join_anew(sets, main, ["first"])
    spread = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    left = sets.where("label <> main").withColumn("i", spread("ni", 0)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("few", F.lit(True))
    right = sets.withColumn("j", spread("nj", 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("few", F.lit(False))
    return left.unionByName(right).select("first", "i", "j", "few", "rep", "label")
