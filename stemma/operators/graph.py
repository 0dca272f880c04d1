"""Kinship graphs as DataFrames.

Nodes are rows with an id column; edges are rows (src, dst). People belong to a lineage directly
(person_id, lineage_id) or through a branch (person_id, branch_id). Every operator is a pure function
of DataFrames; deletions and merges return the resulting tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import cut
from .apply import numbered


def scope_members(belongs_to: DataFrame, in_branch: DataFrame, branches: DataFrame) -> DataFrame:
    """(person_id, lineage_id), each once: direct members and those of a lineage's branches."""
    through = in_branch.join(branches.select("branch_id", "lineage_id"), "branch_id").select("person_id", "lineage_id")
    return belongs_to.select("person_id", "lineage_id").unionByName(through).distinct()


def with_context(persons: DataFrame, belongs_to: DataFrame, in_branch: DataFrame, lineages: DataFrame, branches: DataFrame) -> DataFrame:
    """People with the names of their lineage and branch, null where they have none; the smallest id where several."""
    lin = belongs_to.join(lineages.select("lineage_id", F.col("name").alias("lineage_name")), "lineage_id").groupBy("person_id").agg(F.min_by("lineage_name", "lineage_id").alias("lineage_name"))
    bra = in_branch.join(branches.select("branch_id", F.col("name").alias("branch_name")), "branch_id").groupBy("person_id").agg(F.min_by("branch_name", "branch_id").alias("branch_name"))
    return persons.join(lin, "person_id", "left").join(bra, "person_id", "left")


def person_page(persons: DataFrame, parent_of: DataFrame, members: DataFrame | None = None, name: str = "", gender: str = "unknown", generation: int | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of filtered people by name, then id, with sorted children and parents and the total before paging.

    All filters hold together, membership included; gender "unknown" does not filter.
    """
    p = persons
    if members is not None:
        p = p.join(members.select("person_id").distinct(), "person_id", "left_semi")
    if name:
        p = p.where(F.lower("name").contains(name.lower()))
    if gender != "unknown":
        p = p.where(F.col("gender") == gender)
    if generation is not None:
        p = p.where(F.col("generation") == generation)
    total = p.agg(F.count("*").alias("total"))  # one row
    page = p.orderBy("name", "person_id").offset(offset).limit(limit)
    children = parent_of.join(page.select(F.col("person_id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("person_id")).agg(F.array_sort(F.collect_set("dst")).alias("children"))
    parents = parent_of.join(page.select(F.col("person_id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("person_id")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
    return page.join(children, "person_id", "left").join(parents, "person_id", "left").crossJoin(F.broadcast(total))


def lineage_list(lineages: DataFrame, branches: DataFrame, members: DataFrame) -> DataFrame:
    """Every lineage with its number of people (0 if none) and its branches' names in order of id."""
    n = members.select("lineage_id", "person_id").distinct().groupBy("lineage_id").agg(F.count("person_id").alias("persons"))
    b = branches.groupBy("lineage_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("branch_id", "name"))), lambda x: x["name"]).alias("branches"))
    out = lineages.join(n, "lineage_id", "left").join(b, "lineage_id", "left")
    return out.withColumns({"persons": F.coalesce("persons", F.lit(0).cast("long")), "branches": F.coalesce("branches", F.array().cast("array<string>"))})


def code_of_file(file_name: Column) -> Column:
    """Lineage code in a file name: its first three parts by dashes, upper case, if the first is letters then digits."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", ""), "-")
    return F.when((F.size(parts) >= 3) & F.element_at(parts, 1).rlike("^[A-Za-z]+[0-9]+$"), F.upper(F.array_join(F.slice(parts, 1, 3), "-")))


def refused_branches(new: DataFrame, lineages: DataFrame, branches: DataFrame) -> DataFrame:
    """Rows (lineage_id, name) that may not become branches, with the reason: no such lineage, or a branch of that name."""
    known = new.join(lineages.select("lineage_id", F.lit(True).alias("known")), "lineage_id", "left")
    taken = branches.select("lineage_id", "name", F.lit(True).alias("taken")).distinct()
    out = known.join(taken, ["lineage_id", "name"], "left")
    reason = F.when(F.col("known").isNull(), "no such lineage").when(F.col("taken"), "name taken")
    return out.withColumn("reason", reason).where("reason is not null").select("lineage_id", "name", "reason")


def replace_membership(edges: DataFrame, changes: DataFrame, key: str = "person_id") -> DataFrame:
    """Membership edges after changes: a changed person's old ones go, its new one (unless null) comes."""
    value = next(c for c in edges.columns if c != key)
    return edges.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.where(F.col(value).isNotNull()).select(*edges.columns).dropDuplicates([key]))


def named_edges(edges: DataFrame, persons: DataFrame, kind: str) -> DataFrame:
    """Edges between known people with both names."""
    a, b = (persons.select(F.col("person_id").alias(k), F.col("name").alias(n)) for k, n in (("src", "from_name"), ("dst", "to_name")))
    return edges.join(a, "src").join(b, "dst").select(F.lit(kind).alias("type"), "src", "dst", "from_name", "to_name")


def induced_edges(edges: DataFrame, nodes: DataFrame, key: str = "person_id") -> DataFrame:
    """Edges both of whose ends are among nodes."""
    ids = nodes.select(key).distinct()
    return edges.join(ids.withColumnRenamed(key, "src"), "src", "left_semi").join(ids.withColumnRenamed(key, "dst"), "dst", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(seeds: DataFrame, edges: DataFrame, hops: int, symmetric: bool = False) -> DataFrame:
    """(seed, node, depth): nodes within hops of each seed (column person_id), with the fewest hops.

    Breadth first: each round joins the newest nodes with the edges and drops what was seen. If every edge
    goes both ways (symmetric), a round's nodes can only have been seen in the last two. Edges are
    written once, and rounds are cut by checkpoints, so a plan never grows with the depth.
    """
    edges = cut(edges.select("src", "dst"))
    start = seeds.select(F.col("person_id").alias("seed"), F.col("person_id").alias("node"), F.lit(0).alias("depth")).distinct()
    levels = [cut(start)]
    for depth in range(1, hops + 1):
        step = levels[-1].join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = _stacked(levels[-2:] if symmetric else levels)
        levels.append(cut(step.join(seen, ["seed", "node"], "left_anti")))
        if levels[-1].isEmpty():
            break
    return _stacked(levels)


#: Seeds whose marks are the bits of one number, and edges of a node from which it is split.
BITS, HUB = 64, 10_000


def reach_all(seeds: DataFrame, edges: DataFrame, hops: int, symmetric: bool = False) -> DataFrame:
    """What reach() gives, for very many seeds: 64 of them travel as the bits of one number.

    A round's rows are nodes and blocks of seeds rather than nodes and seeds; what arrives at a node is
    put together by bit_or before it is shuffled, and what was there before is masked out. A node with
    more than `HUB` edges has them dealt to several parts, each with a copy of the node's row.
    """
    ids = seeds.select(F.col("person_id").alias("seed")).where("seed is not null").distinct()
    index = cut(numbered(ids, ["seed"], 0, "k").select("seed", F.floor(F.col("k") / BITS).alias("block"), (F.col("k") % BITS).cast("int").alias("bit")))
    large = edges.groupBy("src").agg(F.ceil(F.count("*") / HUB).alias("parts")).where("parts > 1")
    edges = edges.select("src", "dst").join(large, "src", "left")
    edges = cut(edges.select("src", "dst", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("parts"))).alias("part")))
    large = cut(large)
    mark = F.expr("bit_or(bits)").alias("bits")
    level = index.select(F.col("seed").alias("node"), "block", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("node", "block").agg(mark)
    levels = [cut(level.withColumn("depth", F.lit(0)))]
    seen = levels[0].select("node", "block", "bits")
    for depth in range(1, hops + 1):
        now = levels[-1].join(large.withColumnRenamed("src", "node"), "node", "left")
        now = now.select(F.col("node").alias("src"), "block", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        come = now.join(edges, ["src", "part"]).groupBy(F.col("dst").alias("node"), "block").agg(mark)
        if symmetric:  # where edges go both ways, a node can only have been seen in the last two rounds
            seen = _stacked([x.select("node", "block", "bits") for x in levels[-2:]]).groupBy("node", "block").agg(mark)
        new = come.join(seen.withColumnRenamed("bits", "_seen"), ["node", "block"], "left")
        new = new.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))).where("bits <> 0").select("node", "block", "bits", F.lit(depth).alias("depth"))
        levels.append(cut(new))
        if levels[-1].isEmpty():
            break
        if not symmetric:
            seen = cut(_stacked([seen, levels[-1].select("node", "block", "bits")]).groupBy("node", "block").agg(mark))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    found = _stacked(levels).select("node", "block", "depth", F.explode(bits).alias("bit"))
    return found.join(index, ["block", "bit"]).select("seed", "node", "depth")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def ego_network(seeds: DataFrame, parent_of: DataFrame, spouse_of: DataFrame, hops: int) -> DataFrame:
    """reach() over parents, children and spouses; hops are held within 1 and 12."""
    return reach(seeds, both_ways(parent_of.select("src", "dst").unionByName(spouse_of.select("src", "dst"))), max(1, min(12, hops)), symmetric=True)


def relatives(parent_of: DataFrame, spouse_of: DataFrame, persons: DataFrame, kind: str) -> DataFrame:
    """(person_id, relative_id), each once, for one kind of relative.

    parents, father, mother, grandfather, grandmother, children, son, daughter, sibling, brother, sister,
    spouse, husband, wife. Gendered kinds take relatives whose gender is known.
    """
    gender = {"father": "male", "grandfather": "male", "son": "male", "brother": "male", "husband": "male", "mother": "female", "grandmother": "female", "daughter": "female", "sister": "female", "wife": "female"}.get(kind)
    up = parent_of.select(F.col("dst").alias("person_id"), F.col("src").alias("relative_id"))
    down = parent_of.select(F.col("src").alias("person_id"), F.col("dst").alias("relative_id"))
    known = persons.select("person_id").distinct()
    if kind in ("parents", "father", "mother"):
        out = up
    elif kind in ("grandfather", "grandmother"):
        out = up.join(up.select(F.col("person_id").alias("relative_id"), F.col("relative_id").alias("far")), "relative_id").select("person_id", F.col("far").alias("relative_id"))
    elif kind in ("children", "son", "daughter"):
        out = down
    elif kind in ("sibling", "brother", "sister"):
        out = up.join(down.select(F.col("person_id").alias("relative_id"), F.col("relative_id").alias("other")), "relative_id").where("other <> person_id").select("person_id", F.col("other").alias("relative_id"))
    elif kind in ("spouse", "husband", "wife"):
        out = both_ways(spouse_of).select(F.col("src").alias("person_id"), F.col("dst").alias("relative_id"))
    else:
        raise ValueError(f"no such kind of relative: {kind}")
    whom = persons.where(F.col("gender") == gender) if gender else persons
    out = out.distinct().join(known, "person_id", "left_semi")
    return out.join(whom.select(F.col("person_id").alias("relative_id")).distinct(), "relative_id", "left_semi").select("person_id", "relative_id")


def lineal(seeds: DataFrame, parent_of: DataFrame, down: bool, hops: int = 10, limit: int = 100) -> DataFrame:
    """(seed, node, depth): ancestors, or descendants if down, nearest first; at most limit nodes of each seed, by (depth, id)."""
    edges = parent_of.select("src", "dst") if down else parent_of.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(seeds, edges.distinct(), hops).where("depth > 0")
    rank = F.row_number().over(W.partitionBy("seed").orderBy("depth", "node"))
    return found.withColumn("r", rank).where(F.col("r") <= limit).drop("r")


def person_detail(persons: DataFrame, parent_of: DataFrame, spouse_of: DataFrame) -> DataFrame:
    """People with the ids of parents, children (by birth year, unknown last, then id) and spouses."""
    born = persons.select(F.col("person_id").alias("relative_id"), "birth_year")
    lists = []
    for kind, name in (("parents", "parents"), ("children", "children"), ("spouse", "spouses")):
        r = relatives(parent_of, spouse_of, persons, kind).join(born, "relative_id")
        order = F.struct(F.col("birth_year").isNull().cast("int"), "birth_year", "relative_id") if kind == "children" else F.struct(F.lit(0), F.lit(0), "relative_id")
        lists.append(r.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["relative_id"]).alias(name)))
    out = persons.select("person_id", "name")
    for one in lists:
        out = out.join(one, "person_id", "left")
    return out


def delete_nodes(nodes: DataFrame, edges: dict[str, DataFrame], ids: DataFrame, key: str = "person_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Nodes and edge tables without the given ids; of edges, columns src, dst and key are looked at."""
    ids = ids.select(key).distinct()
    out = {}
    for name, e in edges.items():
        for c in (c for c in e.columns if c in ("src", "dst", key)):
            e = e.join(ids.withColumnRenamed(key, c), c, "left_anti")
        out[name] = e
    return nodes.join(ids, key, "left_anti"), out


def without_isolated(nodes: DataFrame, edges: DataFrame, noise: list[str], focus: int | None = None) -> DataFrame:
    """Nodes with an edge and no noise name, and the focus; all nodes if that leaves none."""
    ends = edges.select(F.col("src").alias("person_id")).unionByName(edges.select(F.col("dst").alias("person_id"))).distinct()
    kept = nodes.join(ends.withColumn("has", F.lit(True)), "person_id", "left").withColumn("ok", (F.coalesce("has", F.lit(False)) & ~F.coalesce(F.col("name").isin(noise), F.lit(False))) | (F.col("person_id") == focus if focus is not None else F.lit(False)))
    any_ = kept.agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("some"))  # one row
    return kept.crossJoin(F.broadcast(any_)).where("ok or not some").select(*nodes.columns)


def rolled_up(persons: DataFrame, in_branch: DataFrame, branches: DataFrame) -> DataFrame:
    """People counted by branch name, largest first; those without a branch as "unassigned", nameless branches as "unnamed"."""
    named = in_branch.join(branches.select("branch_id", F.coalesce(F.nullif("name", F.lit("")), F.lit("unnamed")).alias("branch")), "branch_id")
    own = persons.join(named.select("person_id", "branch"), "person_id", "left")
    return own.groupBy(F.coalesce("branch", F.lit("unassigned")).alias("branch")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "branch")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(person_id, degree): ends of edges at each node, 0 for isolated ones."""
    ends = edges.select(F.col("src").alias("person_id")).unionByName(edges.select(F.col("dst").alias("person_id")))
    return nodes.select("person_id").join(ends.groupBy("person_id").agg(F.count("*").alias("degree")), "person_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def label_counts(nodes: dict[str, DataFrame]) -> DataFrame:
    """(label, n): how many nodes there are under each label."""
    out = None
    for label, df in nodes.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out
