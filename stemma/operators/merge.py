"""Merging people into others, chains and stars of merges at once.

Merges form trees. What a person takes from those merged into it comes in the order of a walk through
its tree: each secondary, then whoever was merged into that one, by the order of the merges. Places in
that walk are found by list ranking: every merge is a step down and a step up, each knows the next one,
and pointers are doubled until they reach the end. A chain of a million merges takes twenty rounds, and
no join has a frequent key, however many are merged into one person.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from .apply import Graph, numbered

#: Kinds of edges between people without a direction.
UNDIRECTED = ("spouse",)
#: Genders that do not count as known.
NO_GENDER = ("", "unknown")


def merge_places(persons: DataFrame, mapping: DataFrame) -> DataFrame:
    """(person_id, root, place, blocked) of everyone who is merged: who is left of them, and the place in the walk through that one's tree.

    mapping has (secondary, primary, ord); of several merges of one secondary the first counts, merges of
    or into people that there are not, and into oneself, do not. blocked: someone between the two has a
    null gender, which takes none (persons has gender). A circle of merges is an error.
    """
    known = persons.select("person_id").distinct()
    named = mapping.where("secondary <> primary").select("secondary", "primary", F.col("ord").cast("long").alias("ord"))
    for side in ("secondary", "primary"):
        named = named.join(known.withColumnRenamed("person_id", side), side, "left_semi")
    once = named.groupBy("secondary").agg(F.min(F.struct("ord", "primary")).alias("m")).select("secondary", "m.primary", "m.ord")
    steps = cut(numbered(once, ["primary", "ord", "secondary"], 0, "n"))
    nulls = persons.where("gender is null").select(F.col("person_id").alias("secondary"), F.lit(1).alias("open")).distinct()
    own = steps.join(nulls, "secondary", "left").na.fill(0, ["open"])
    first = steps.groupBy(F.col("primary").alias("secondary")).agg(F.min("n").alias("child"))
    last = steps.groupBy("primary").agg(F.max("n").alias("n"))
    above = steps.select(F.col("secondary").alias("primary"), F.col("n").alias("up"))
    # down is 2n, up is 2n + 1; behind the last of a root's own there is nothing
    down = own.join(first, "secondary", "left").select((F.col("n") * 2).alias("e"), (F.coalesce(F.col("child") * 2, F.col("n") * 2 + 1)).alias("next"), F.lit(1).cast("long").alias("dist"), F.col("open").cast("long").alias("sum"), F.lit(None).cast("long").alias("root"))
    ends = last.join(above, "primary", "left").select("n", F.col("up"), F.col("primary").cast("long").alias("top"), F.lit(True).alias("end"))
    up = own.join(ends, "n", "left").select((F.col("n") * 2 + 1).alias("e"), F.when(F.col("end"), F.col("up") * 2 + 1).otherwise(F.col("n") * 2 + 2).alias("next"), F.lit(1).cast("long").alias("dist"), (-F.col("open")).cast("long").alias("sum"), F.when(F.col("end") & F.col("up").isNull(), F.col("top")).alias("root"))
    walk = cut(down.unionByName(up))
    rounds = 2 + math.ceil(math.log2(max(2, 2 * steps.count())))
    while not walk.where("next is not null").isEmpty():
        if not rounds:
            raise ValueError("merges run in a circle")
        rounds -= 1
        to = walk.select(F.col("e").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"), F.col("sum").alias("_sum"), F.col("root").alias("_root"))
        open_ = walk.where("next is not null").join(to, "next").select("e", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.col("sum") + F.col("_sum")).alias("sum"), F.col("_root").alias("root"))
        walk = cut(walk.where("next is null").unionByName(open_))
    found = steps.join(walk.withColumn("n", F.shiftright("e", 1)).where("e % 2 = 0"), "n")
    return found.select(F.col("secondary").alias("person_id"), "root", (-F.col("dist")).alias("place"), (F.col("sum") < 0).alias("blocked"))


def _first(column: str, ok: Column, place: Column) -> Column:
    return F.min_by(column, F.when(ok, place))


def merged_people(persons: DataFrame, places: DataFrame) -> DataFrame:
    """People after merging: what one lacks is taken from the first secondary that has it.

    A null lacks a value; of name and notes an empty text does, too; a gender does if it is empty or
    unknown, but not if it is null, and then hides those merged into that person.
    """
    rows = persons.join(places, "person_id", "left").withColumns({"place": F.coalesce("place", F.lit(-(1 << 62))), "_own": F.col("root").isNull(), "root": F.coalesce("root", "person_id")})
    place, out = F.col("place"), []
    for c in (c for c in persons.columns if c != "person_id"):
        value = F.col(c)
        if c == "gender":
            own = F.max(F.when(F.col("_own"), value))
            other = _first(c, ~F.col("_own") & ~F.coalesce("blocked", F.lit(False)) & value.isNotNull() & ~value.isin(*NO_GENDER), place)
            out.append(F.when(own.isin(*NO_GENDER), F.coalesce(other, own)).otherwise(own).alias(c))
        elif c in ("name", "notes"):
            out.append(F.coalesce(_first(c, value.isNotNull() & (value != ""), place), F.max_by(c, place)).alias(c))
        else:
            out.append(_first(c, value.isNotNull(), place).alias(c))
    return rows.groupBy(F.col("root").alias("person_id")).agg(*out).select(*persons.columns)


def moved_edges(edges: DataFrame, places: DataFrame, undirected: tuple[str, ...] = UNDIRECTED) -> DataFrame:
    """Edges (type, src, dst, rel_id, marriage_date) after merging: ends move, each edge is there once, whichever way round if undirected.

    Edges between people who become one go. An edge that was there keeps its rel_id, a moved one has an
    id made of its kind and ends; the date is the edge's own, else that of the first one that is moved onto
    it. An undirected edge that is moved leads from the person who took it over.
    """
    a, b = (places.select(F.col("person_id").alias(c), F.col("root").alias(f"_{c}"), F.col("place").alias(f"_{c}_place")) for c in ("src", "dst"))
    rows = edges.select("type", "src", "dst", "rel_id", "marriage_date").join(a, "src", "left").join(b, "dst", "left")
    src, dst = F.coalesce("_src", "src"), F.coalesce("_dst", "dst")
    rows = rows.where((src != dst) | (F.col("src") == F.col("dst")) & F.col("_src").isNull())
    moved = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    turned = F.col("type").isin(*undirected) & F.col("_src").isNull() & F.col("_dst").isNotNull()
    rows = rows.select("type", F.when(turned, dst).otherwise(src).alias("src"), F.when(turned, src).otherwise(dst).alias("dst"), "rel_id", "marriage_date", moved.alias("moved"), F.struct(moved.alias("m"), F.coalesce("_src_place", "_dst_place").alias("p"), F.col("rel_id"), F.col("src").alias("s"), F.col("dst").alias("d")).alias("order"))
    either = F.col("type").isin(*undirected)
    ends = [F.when(either, F.least("src", "dst")).otherwise(F.col("src")).alias("x"), F.when(either, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("y")]
    one = rows.groupBy("type", *ends).agg(F.min_by(F.struct("src", "dst", "rel_id", "moved"), "order").alias("e"), F.min_by("marriage_date", F.when(F.col("marriage_date").isNotNull(), F.col("order"))).alias("marriage_date"))
    made = F.substring(F.sha2(F.concat_ws("|", "type", F.col("e.src").cast("string"), F.col("e.dst").cast("string")), 256), 1, 24)
    return one.select("type", "e.src", "e.dst", F.when(F.col("e.moved"), made).otherwise(F.col("e.rel_id")).alias("rel_id"), "marriage_date")


def merge_people(graph: Graph, mapping: DataFrame) -> Graph:
    """The graph after all merges (secondary, primary, ord), as if those further down a chain came first: people, edges, memberships, documents."""
    places = cut(merge_places(graph.persons, mapping))
    to = places.select("person_id", "root")

    def member(df: DataFrame, other: str) -> DataFrame:
        return df.join(to, "person_id", "left").select(F.coalesce("root", "person_id").alias("person_id"), other).distinct()

    return Graph(merged_people(graph.persons, places), moved_edges(graph.edges, places), member(graph.belongs_to, "lineage_id"), member(graph.in_branch, "branch_id"), member(graph.has_document, "doc_id"))
