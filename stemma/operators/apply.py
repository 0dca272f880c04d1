"""Applying reviewed results of tasks to the graph: people matched or created, relations, memberships, documents, counters.

Tasks are applied all at once, with the rows that come of applying them one after the other in order of
task_id. What decides is the order of mentions: a task's people by place, then the ends of its relations
by place. A person is found by the name's key alone, so each key is resolved once, wherever it occurs.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..plans.cut import cut

#: Attributes of a person that reviewed results may fill.
FILLED = ("birth_year", "death_year", "birth_place", "biography")


class Graph(NamedTuple):
    """persons (person_id, name, gender, created_at, *FILLED), edges (type, src, dst, rel_id, marriage_date), memberships and documents."""

    persons: DataFrame
    edges: DataFrame
    belongs_to: DataFrame
    in_branch: DataFrame
    has_document: DataFrame


def numbered(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """df with the numbers from start on in a column: rows by order, whose values are distinct.

    Rows are dealt by ranges of the order; a partition's numbers begin behind those of the ones before,
    so no task sees more than its own rows, and the numbers do not depend on how rows are dealt.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, seen = [], start
    for p, n in counts:
        before.append((p, seen))
        seen += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def _yes(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(True))


def _made(kind: Column, *ends: Column) -> Column:
    """An id for a new edge, the same at every run."""
    return F.substring(F.sha2(F.concat_ws("|", kind, *(e.cast("string") for e in ends)), 256), 1, 24)


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, src, dst, rel_id, marriage_date) after new edges, each once (type, src, dst, marriage_date).

    An edge that exists keeps its rel_id, or gets one if it has none; a new one's marriage date takes the
    place of the old one's, null too.
    """
    n = new.select("type", "src", "dst", F.col("marriage_date").alias("_date"), F.lit(True).alias("_new"))
    both = old.select("type", "src", "dst", "rel_id", "marriage_date").join(n, ["type", "src", "dst"], "full")
    rel = F.when(F.col("_new"), F.coalesce("rel_id", _made(F.col("type"), F.col("src"), F.col("dst")))).otherwise(F.col("rel_id"))
    return both.select("type", "src", "dst", rel.alias("rel_id"), F.when(F.col("_new"), F.col("_date")).otherwise(F.col("marriage_date")).alias("marriage_date"))


def _foremost(rows: DataFrame, keys: list[str], tasks: Column) -> DataFrame:
    """rows of the tasks that decide for their keys (tasks: aggregates of task ids in a struct), so that what is then sorted by order is few rows for each key."""
    bound = cut(rows.groupBy(*keys).agg(tasks.alias("_at")).select(*keys, F.array_compact(F.array("_at.*")).alias("_at")))
    return rows.join(bound, keys).where(F.array_contains("_at", F.col("task_id"))).drop("_at")


class Applied:
    """Reviewed tasks applied to a graph, as apply_reviewed() says; each part is made when it is asked for, what several need once."""

    def __init__(self, graph: Graph, tasks: DataFrame, people: DataFrame, relations: DataFrame, lineages: DataFrame, branches: DataFrame):
        self.graph, self.lineages, self.branches = graph, lineages, branches
        self.tasks = tasks.select("task_id", "lineage_id", "branch_id", "doc_id")
        self._people, self._relations = people, relations

    @cached_property
    def said(self) -> DataFrame:
        rows = self._people.where(_yes("confirmed")).withColumn("name", N.stripped(F.col("name"))).where("name <> ''")
        gender = F.when(F.col("gender").isin("male", "female"), F.col("gender")).otherwise("unknown")
        return cut(rows.select("task_id", "place", "name", N.graph_key(F.col("name")).alias("key"), gender.alias("gender"), *FILLED))

    @cached_property
    def wanted(self) -> DataFrame:
        rows = self._relations.where(_yes("confirmed")).select("task_id", "place", "marriage_date", *(N.stripped(F.col(c)).alias(c) for c in ("type", "from_name", "to_name")))
        good = F.col("type").isin("parent_child", "spouse") & (F.col("from_name") != "") & (F.col("to_name") != "")
        return cut(rows.withColumns({"good": good, "fk": N.graph_key(F.col("from_name")), "tk": N.graph_key(F.col("to_name"))}))

    @cached_property
    def mentions(self) -> DataFrame:
        order = lambda kind, side: F.struct(F.col("task_id"), F.lit(kind).alias("kind"), F.col("place"), side.alias("side")).alias("order")
        said = self.said.select("task_id", order(0, F.lit(0)), "name", "key", "gender", *FILLED)
        end = lambda side, name, key: F.struct(F.lit(side).alias("side"), F.col(name).alias("name"), F.col(key).alias("key"))
        ends = self.wanted.where("good").select("task_id", "place", F.explode(F.array(end(0, "from_name", "fk"), end(1, "to_name", "tk"))).alias("e"))
        ends = ends.select("task_id", order(1, F.col("e.side")), "e.name", "e.key", F.lit("unknown").alias("gender"))
        return said.unionByName(ends, allowMissingColumns=True)

    @cached_property
    def _both(self) -> DataFrame:
        at = F.col("task_id")
        rows = _foremost(self.mentions, ["key"], F.struct(F.min(at).alias("any"), *(F.min(F.when(F.col(c).isNotNull(), at)).alias(c) for c in FILLED)))
        first = rows.groupBy("key").agg(F.min_by(F.struct("name", "gender"), "order").alias("f"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c) for c in FILLED))
        age = F.struct(F.col("created_at").isNull().alias("a"), F.col("created_at").alias("b"), F.col("person_id").alias("c"))
        known = self.graph.persons.withColumn("key", N.graph_key(F.col("name"))).groupBy("key").agg(F.min_by("person_id", age).alias("person_id"))
        return cut(first.join(known, "key", "left"))

    @cached_property
    def _new(self) -> DataFrame:
        top = self.graph.persons.agg(F.max("person_id")).first()[0]
        return numbered(self._both.where("person_id is null").drop("person_id"), ["key"], (top if top is not None else 0) + 1, "person_id")

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(self._both.where("person_id is not null").select("key", "person_id").unionByName(self._new.select("key", "person_id")))

    @cached_property
    def persons(self) -> DataFrame:
        fill = self._both.where("person_id is not null")
        old = self.graph.persons.join(fill.select("person_id", *(F.col(c).alias(f"_{c}") for c in FILLED)), "person_id", "left")
        filled = old.withColumns({c: F.coalesce(c, f"_{c}") for c in FILLED}).select(*self.graph.persons.columns)
        return filled.unionByName(self._new.select("person_id", "f.name", "f.gender", *FILLED), allowMissingColumns=True)

    @cached_property
    def mapping(self) -> DataFrame:
        """A name has one key and that one person: each row once."""
        return cut(self.mentions.select("task_id", "name", "key").repartition("task_id").distinct().join(self.resolved, "key").select("task_id", "name", "person_id"))

    @cached_property
    def edges(self) -> DataFrame:
        a, b = (self.resolved.select(F.col("key").alias(k), F.col("person_id").alias(v)) for k, v in (("fk", "src"), ("tk", "dst")))
        tied = self.wanted.where("good").select("task_id", "place", "type", "fk", "tk", "marriage_date").join(a, "fk").join(b, "tk").drop("fk", "tk")
        tied = _foremost(tied, ["type", "src", "dst"], F.struct(F.max("task_id").alias("any")))
        last = tied.groupBy("type", "src", "dst").agg(F.max_by("marriage_date", F.struct("task_id", "place")).alias("marriage_date"))
        return merged_edges(self.graph.edges, last)

    @cached_property
    def _placed(self) -> DataFrame:
        tasks = self.tasks.where("lineage_id is not null")
        last = self.mapping.join(tasks.select("task_id"), "task_id", "left_semi").groupBy("person_id").agg(F.max("task_id").alias("task_id"))
        return cut(last.join(tasks, "task_id").groupBy("person_id").agg(F.max_by(F.struct("lineage_id", "branch_id"), "task_id").alias("p")).select("person_id", "p.*"))

    def _kept(self, members: DataFrame) -> DataFrame:
        return members.join(self._placed.select("person_id"), "person_id", "left_anti")

    @cached_property
    def belongs_to(self) -> DataFrame:
        own = self._placed.join(self.lineages.select("lineage_id").distinct(), "lineage_id", "left_semi").select("person_id", "lineage_id")
        return self._kept(self.graph.belongs_to).select("person_id", "lineage_id").unionByName(own)

    @cached_property
    def in_branch(self) -> DataFrame:
        own = self._placed.join(self.branches.select("branch_id", "lineage_id").distinct(), ["branch_id", "lineage_id"], "left_semi").select("person_id", "branch_id")
        return self._kept(self.graph.in_branch).select("person_id", "branch_id").unionByName(own)

    @cached_property
    def has_document(self) -> DataFrame:
        own = self.mapping.join(self.tasks.where("doc_id is not null"), "task_id").select("person_id", "doc_id")
        return self.graph.has_document.select("person_id", "doc_id").unionByName(own).distinct()

    @cached_property
    def counters(self) -> DataFrame:
        whole = self.mapping.groupBy("task_id").agg(F.count_distinct("person_id").alias("created_persons"))
        rows = self.said.groupBy("task_id", "key").agg(F.count("*").alias("n")).join(self.resolved, "key")
        linked = rows.groupBy("task_id").agg((F.sum("n") - F.count_distinct("person_id")).alias("linked_persons"))
        tie = self.wanted.groupBy("task_id").agg(F.count_if("good").alias("created_relations"), F.count_if(~F.col("good")).alias("skipped"))
        return self.tasks.select("task_id").join(whole, "task_id", "left").join(linked, "task_id", "left").join(tie, "task_id", "left").na.fill(0)


def apply_reviewed(graph: Graph, tasks: DataFrame, people: DataFrame, relations: DataFrame, lineages: DataFrame, branches: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """(the graph after, counters, mapping) of tasks (task_id, lineage_id, branch_id, doc_id) with their reviewed rows.

    people: (task_id, place, name, gender, *FILLED, confirmed); relations: (task_id, place, type,
    from_name, to_name, marriage_date, confirmed). Rows that are not confirmed count for nothing; null
    is confirmed. Of namesakes in the graph the oldest is meant (created_at, null last, then id), and only
    what it lacks is filled. Nobody of a name: a person is created, numbered behind the largest id in
    order of the name's key, with the gender of the first mention (an end of a relation has none, other
    words than male and female are unknown) and for each attribute the first value. Relations of other
    types or without a name at an end are skipped and counted. Whoever a task with a lineage mentions is
    in that lineage and branch alone afterwards, if there are such; the last task counts. counters:
    (task_id, created_persons, linked_persons, created_relations, skipped), the first being all
    people of a task; mapping: (task_id, name, person_id).
    """
    after = Applied(graph, tasks, people, relations, lineages, branches)
    return Graph(after.persons, after.edges, after.belongs_to, after.in_branch, after.has_document), after.counters, after.mapping
