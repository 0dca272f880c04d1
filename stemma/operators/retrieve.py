"""Retrieval over text entries: words, vectors, both, and questions about people."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from .dictionary import occurrences
from .graph import lineal, relatives

# What a question asks for, by the first phrase that it has, in this order.
INTENTS = {
    "father": ["父亲", "爸爸", "老爸", "老爹", "爹"],
    "mother": ["母亲", "妈妈", "老妈", "老娘", "娘"],
    "parents": ["父母", "双亲"],
    "grandfather": ["祖父", "爷爷", "阿公"],
    "grandmother": ["祖母", "奶奶", "阿婆"],
    "son": ["儿子"],
    "daughter": ["女儿"],
    "children": ["子女", "孩子", "儿女", "后人", "后代", "子孙", "孙辈"],
    "brother": ["兄弟", "哥哥", "弟弟", "兄长", "小弟"],
    "sister": ["姐妹", "姐姐", "妹妹", "姊妹"],
    "sibling": ["兄弟姐妹", "同胞"],
    "spouse": ["配偶", "另一半"],
    "husband": ["丈夫", "老公", "夫君"],
    "wife": ["妻子", "老婆", "夫人", "太太", "媳妇"],
    "ancestor": ["祖先", "先祖", "祖宗", "祖辈", "上辈", "长辈"],
    "descendant": ["后代", "子孙", "后人", "曾孙", "重孙"],
    "birthplace": ["出生地", "籍贯", "故乡", "老家", "家乡", "出生于", "哪里人"],
    "lifetime": ["生年", "出生年份", "生辰", "生于", "寿命", "享年", "卒年", "去世", "活了多久"],
    "biography": ["简介", "生平", "事迹", "经历"],
    "generation": ["第几代", "辈分", "代数", "世代"],
}


def keyword_search(entries: DataFrame, tokens: list[str], limit: int = 12, lineage_id: int | None = None) -> DataFrame:
    """Active entries, of one lineage if it is given, by words they have: 2 for each in title or type, else 1 for each in the text; then page (unknown is 0), then newest id."""
    rows = entries.where("status = 'active'")
    if lineage_id is not None:
        rows = rows.where(F.col("lineage_id") == lineage_id)
    hit = lambda t: F.when(F.contains(F.coalesce("title", F.lit("")), F.lit(t)) | F.contains(F.coalesce("type", F.lit("")), F.lit(t)), 2).when(F.contains(F.coalesce("text", F.lit("")), F.lit(t)), 1).otherwise(0)
    score = sum((hit(t) for t in tokens), F.lit(0))
    return rows.withColumn("hits", score).where("hits > 0").orderBy(F.desc("hits"), F.coalesce("page_no", F.lit(0)), F.desc("entry_id")).limit(limit)


def to_index(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active entries without a vector, or with one older than they are, and the text to embed."""
    out = entries.where("status = 'active'").join(vectors.select("entry_id", F.col("updated_at").alias("indexed_at")), "entry_id", "left")
    return out.where(F.col("indexed_at").isNull() | (F.col("updated_at") > F.col("indexed_at"))).select("entry_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 1200)).alias("input"))


def stale_vectors(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of entries that are gone or not active."""
    return vectors.join(entries.where("status = 'active'").select("entry_id"), "entry_id", "left_anti").select("entry_id")


def readiness(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active entries, those of them that are indexed, and whether that is all of them, at least one."""
    a = entries.where("status = 'active'").select("entry_id")
    n = a.join(vectors.select("entry_id", F.lit(1).alias("has")), "entry_id", "left").agg(F.count("*").alias("active"), F.count("has").alias("indexed"))
    return n.withColumn("ready", (F.col("active") > 0) & (F.col("active") == F.col("indexed")))


def normalised(vector: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rebuilt(entries: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A new vector table of all active entries, whatever there was, and one row with how many went in and out.

    embed takes (entry_id, input) and gives (entry_id, vector).
    """
    fresh = embed(to_index(entries, vectors.limit(0)))
    return fresh, fresh.agg(F.count("*").alias("synced")).crossJoin(vectors.agg(F.count("*").alias("deleted")))  # one row each


def nearest(vectors: DataFrame, query: list[float], k: int = 60) -> DataFrame:
    """The k entries (5 to 200) whose vectors are most alike to the query, empty ones aside, with sim."""
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    out = vectors.where(F.size("vector") == len(query)).withColumn("sim", dot(normalised(F.col("vector")), q))
    return out.orderBy(F.desc("sim"), "entry_id").limit(max(5, min(200, k)))


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 60, block: int = 2000) -> DataFrame:
    """(query_id, entry_id, sim, place): for each query (query_id, vector) the k entries (5 to 200) whose vectors are most alike.

    Queries and vectors meet in blocks of about `block` of each, by matrix products; only a block's k best
    for each query leave it. Vectors of another length than the query's are passed over.
    """
    k = max(5, min(200, k))
    n, m = (df.agg(F.count("*")).first()[0] for df in (vectors, queries))
    across, down = max(1, -(-n // block)), max(1, -(-m // block))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    unit = lambda v: normalised(F.col(v)).alias("vector")
    to_all = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))  # noqa: E731  of vectors that are normalised already: once each, not once a copy
    there = vectors.where(F.size("vector") > 0).select("entry_id", unit("vector"), F.size("vector").alias("width"), deal("entry_id", across).alias("i")).withColumn("j", to_all(down))
    asked = queries.where(F.size("vector") > 0).select("query_id", unit("vector"), F.size("vector").alias("width"), deal("query_id", down).alias("j")).withColumn("i", to_all(across))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "entry_id": [], "sim": []})
        b = b.sort_values("entry_id", ignore_index=True)
        sims = np.round(np.array(a["vector"].tolist()) @ np.array(b["vector"].tolist()).T, 9)  # equal vectors are equally near
        n = min(k, len(b))
        least = np.partition(sims, len(b) - n, axis=1)[:, len(b) - n]  # of each query the n-th best; only what is as good is sorted
        row, at = np.nonzero(sims >= least[:, None])
        order = np.lexsort((at, -sims[row, at], row))
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[place < n], at[place < n]
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[row], "entry_id": b["entry_id"].to_numpy()[at], "sim": sims[row, at]})

    found = asked.groupBy("i", "j", "width").cogroup(there.groupBy("i", "j", "width")).applyInPandas(best, "query_id long, entry_id long, sim double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "entry_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def assembled(ranked: DataFrame, entries: DataFrame, lineages: DataFrame, branches: DataFrame, limit: int) -> DataFrame:
    """Hits of a ranked list (entry_id, rank from 0): what there is to show of each entry, its rank as a score, and the names of its lineage and branch.

    Entries that are gone are dropped without closing the ranks; unknown names are empty.
    """
    score = F.bround(1 - F.col("rank") / (limit + 1.0), 3) if limit else F.lit(0.0)
    top = ranked.where(F.col("rank") < limit) if limit else ranked.limit(0)
    hits = top.join(entries, "entry_id").withColumn("score", score).withColumn("title", F.coalesce("title", F.lit("")))
    hits = hits.join(lineages.select("lineage_id", F.col("name").alias("lineage_name")), "lineage_id", "left").join(branches.select("branch_id", F.col("name").alias("branch_name")), "branch_id", "left")
    return hits.select("entry_id", "type", "title", "text", "page_no", "lineage_id", "branch_id", "rank", "score", F.coalesce("lineage_name", F.lit("")).alias("lineage_name"), F.coalesce("branch_name", F.lit("")).alias("branch_name"))


def reranked(hits: DataFrame, sim: str, score: str, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits by score where there is one, else by similarity, with place and a score of the place; the first `limit` of each question (by)."""
    order = [F.desc_nulls_last(score), F.desc(sim), F.col("entry_id")]
    top = hits if by else hits.orderBy(*order).limit(limit)  # of one question: a bounded list
    ranked = top.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= limit)
    return ranked.withColumn("place_score", F.bround(1 - (F.col("place") - 1) / (limit + 1.0), 3))


def recall_report(hits: DataFrame, sim: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Places before and after reranking of a bounded list of hits for each question (by)."""
    place = lambda *order: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    return hits.select(*by, "entry_id", F.round(sim, 4).alias("sim"), F.round(score, 4).alias("rerank_score"), place(F.desc(sim), F.col("entry_id")).alias("from_place"), place(F.desc_nulls_last(score), F.desc(sim), F.col("entry_id")).alias("place"))


def hybrid(vector_hits: DataFrame, word_hits: DataFrame, ready: DataFrame) -> DataFrame:
    """Hits by vectors if the index is ready and there are any, else by words; source says which."""
    v = vector_hits.select("entry_id", F.lit("vector").alias("source")).crossJoin(F.broadcast(ready.select("ready"))).where("ready").drop("ready")
    none = v.agg(F.count("*").alias("n"))  # one row
    w = word_hits.select("entry_id", F.lit("keyword").alias("source")).crossJoin(F.broadcast(none)).where("n = 0").drop("n")
    return v.unionByName(w)


def page_image(task: Column, page: Column) -> Column:
    return F.when(task.isNotNull() & page.isNotNull(), F.format_string("/files/scans/%s/page_%03d.png", task.cast("string"), page.cast("int")))


def plain_answer(hits: DataFrame, group: str, order: str, most: int = 5, chars: int = 120) -> DataFrame:
    """The first heads of texts of each group's hits, each once."""
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("r") <= most)
    heads = F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"])
    return ranked.groupBy(group).agg(F.array_join(F.array_distinct(heads), "\n").alias("answer"))


def person_materials(entries: DataFrame, name: str, lineage_id: int, branch_id: int | None, limits: tuple[int, int, int] = (40, 30, 30)) -> DataFrame:
    """What is written about a person (the name in title or text), their branch, and their lineage as a whole; by scope, type and page."""
    key = N.text_key(F.lit(name))
    rows = entries.where("status = 'active'").where(F.col("lineage_id") == lineage_id)
    mine = rows.where(F.contains(N.text_key(F.col("title")), key) | F.contains(N.text_key(F.col("text")), key))
    branch = rows.where(F.col("branch_id") == branch_id) if branch_id is not None else rows.limit(0)
    whole = rows.where("branch_id is null")
    order = [F.col("type").asc_nulls_last(), F.col("page_no").asc_nulls_last(), F.col("entry_id")]
    out = None
    for scope, part, n in zip(("person", "branch", "lineage"), (mine, branch, whole), limits, strict=True):
        one = part.orderBy(*order).limit(n).select(F.lit(scope).alias("scope"), "entry_id", "type", "page_no")
        out = one if out is None else out.unionByName(one)
    return out


def materials_of(entries: DataFrame, people: DataFrame, most: int = 40) -> DataFrame:
    """(person_id, r, entry_id) for all people (person_id, name) at once: the first active entries that have the name in title or text, by page, then id.

    Names and texts are compared without white space and in lower case; an automaton of all names goes
    once over each entry. A name without a letter finds nothing.
    """
    active = entries.where("status = 'active'")
    keys = people.select("person_id", N.text_key(F.col("name")).alias("key")).where("key <> ''")
    # a title is no beginning of a text: a line end, which is in no name, stands between them
    both = active.select("entry_id", F.concat(N.text_key(F.col("title")), F.lit("\n"), N.text_key(F.col("text"))).alias("both"))
    found = occurrences(both, keys, "entry_id", "both", "key").select("entry_id", F.col("word").alias("key")).distinct().join(keys, "key")
    placed = found.join(active.select(F.col("entry_id").cast("long").alias("entry_id"), "page_no"), "entry_id")
    rank = F.row_number().over(W.partitionBy("person_id").orderBy(F.col("page_no").asc_nulls_last(), "entry_id"))
    return placed.withColumn("r", rank).where(F.col("r") <= most).select("person_id", "r", "entry_id")


def intent(question: Column, table: dict[str, list[str]] = INTENTS) -> Column:
    """The first intent any of whose phrases the question has; null if none."""
    out = F.lit(None).cast("string")
    for name, phrases in reversed(table.items()):
        any_ = F.lit(False)
        for p in phrases:
            any_ = any_ | F.contains(question, F.lit(p))
        out = F.when(any_, name).otherwise(out)
    return out


# What is asked for, by intent, and how answers are worded.
LABELS = {
    "father": "父亲", "mother": "母亲", "parents": "父母", "grandfather": "祖父", "grandmother": "祖母", "son": "儿子", "daughter": "女儿", "children": "子女", "brother": "兄弟", "sister": "姐妹", "sibling": "兄弟姐妹",
    "spouse": "配偶", "husband": "丈夫", "wife": "妻子", "ancestor": "祖先", "descendant": "后代", "birthplace": "出生地", "lifetime": "生卒年", "biography": "简介", "generation": "世代",
}
OTHER_LABEL = "相关人物"
NOT_RECORDED = "暂未记录该信息。"
NOT_FOUND = "抱歉，未查询到 {} 的{}信息。"
FOUND = "{}的{}：{}"
MORE = " 等 {} 人"


def _worded(pattern: str, *values: Column) -> Column:
    parts = pattern.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))))


def answer(asked: Column, name: Column, people: Column, told: Column | None = None, most: int = 20) -> Column:
    """The answer to a question of an intent about a person: people with their years (unknown or 0: ?), `most` at most and how many there are.

    Intents that ask for an attribute get what is told, or that it is not recorded; nobody found is said too.
    """
    label = F.lit(OTHER_LABEL)
    for k, v in LABELS.items():
        label = F.when(asked == k, v).otherwise(label)
    year = lambda c: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit("?"))
    one = lambda p: F.concat(p["name"], F.lit("（"), year(p["birth_year"]), F.lit(" — "), year(p["death_year"]), F.lit("）"))
    n = F.coalesce(F.array_size(people), F.lit(0))
    shown = F.concat(F.array_join(F.transform(F.slice(people, 1, most), one), "、"), F.when(n > most, _worded(MORE, n.cast("string"))).otherwise(""))
    related = F.when(n == 0, _worded(NOT_FOUND, name, label)).otherwise(_worded(FOUND, name, label, shown))
    attribute = F.coalesce(told, F.lit(NOT_RECORDED)) if told is not None else F.lit(NOT_RECORDED)
    return F.when(F.coalesce(asked.isin("birthplace", "lifetime", "biography", "generation"), F.lit(False)), attribute).otherwise(related)


def question_trees(found: DataFrame, edges: dict[str, DataFrame]) -> DataFrame:
    """(question_id, type, src, dst): of each question the edges between the person asked for and the people found.

    found has (question_id, person_id, relative_id); questions that found nobody have no edges. All
    questions are answered by two joins with each edge table.
    """
    nodes = found.select("question_id", F.col("person_id").alias("node")).unionByName(found.select("question_id", F.col("relative_id").alias("node"))).where("node is not null").distinct()
    out = None
    for kind, e in edges.items():
        own = e.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src")
        own = own.join(nodes.withColumnRenamed("node", "dst"), ["question_id", "dst"], "left_semi").select("question_id", F.lit(kind).alias("type"), "src", "dst")
        out = own if out is None else out.unionByName(own)
    return out


def introduction(people: DataFrame, materials: DataFrame, found: DataFrame) -> DataFrame:
    """(person_id, name, facts, context, sources): what an introduction of a person can be written from; people without material are left out.

    people: (person_id, name, birth_year, death_year, birth_place, generation). materials and found:
    (person_id, ord, scope, type, title, text); of those with a text the first eight materials count, and
    the first six of found where there is no material. Texts are cut to 400 characters.
    """
    filled = lambda df, most: df.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("r", F.row_number().over(W.partitionBy("person_id").orderBy("ord"))).where(F.col("r") <= most)
    own = filled(materials, 8).select("person_id", "r", "scope", "type", "title", "text")
    other = filled(found, 6).select("person_id", "r", F.lit("lineage").alias("scope"), F.coalesce(F.nullif("type", F.lit("")), F.lit("谱书")).alias("type"), "title", "text").join(own.select("person_id").distinct(), "person_id", "left_anti")
    text = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(F.lit("〔"), F.coalesce("scope", F.lit("谱书")), F.lit("·"), text(F.col("type")), F.lit("〕"), text(F.col("title")), F.lit("\n"), F.substring(text(F.col("text")), 1, 400))
    context = own.unionByName(other).groupBy("person_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"), F.count("*").alias("sources"))
    year = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("?"))
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    facts = F.concat_ws("；", F.when(known("birth_year") | known("death_year"), F.concat(F.lit("生卒 "), year("birth_year"), F.lit("—"), year("death_year"))), F.when(text(F.col("birth_place")) != "", F.concat(F.lit("籍贯 "), "birth_place")), F.when(F.col("generation").isNotNull(), F.concat(F.lit("第"), F.col("generation").cast("string"), F.lit("代"))))
    return people.join(context, "person_id").select("person_id", "name", F.coalesce(F.nullif(facts, F.lit("")), F.lit("暂无额外结构化信息")).alias("facts"), "context", "sources")


#: Intents that ask for a property of the person rather than for relatives.
PROPERTIES = ("birthplace", "lifetime", "biography", "generation")


def property_answer(person: Column, asked: Column) -> Column:
    """The answer to a property intent; null where it is not known."""
    year = lambda c: F.coalesce(F.nullif(person[c], F.lit(0)).cast("string"), F.lit("?"))
    known = (F.coalesce(person["birth_year"], F.lit(0)) != 0) | (F.coalesce(person["death_year"], F.lit(0)) != 0)
    return (
        F.when(asked == "birthplace", F.nullif(person["birth_place"], F.lit("")))
        .when(asked == "lifetime", F.when(known, F.concat(year("birth_year"), F.lit(" 年 — "), year("death_year"), F.lit(" 年"))))
        .when(asked == "biography", F.nullif(person["biography"], F.lit("")))
        .when(asked == "generation", F.when(person["generation"].isNotNull(), F.concat(F.lit("第 "), person["generation"].cast("string"), F.lit(" 代"))))
    )


def dispatched(asked: DataFrame, persons: DataFrame, parent_of: DataFrame, spouse_of: DataFrame) -> DataFrame:
    """(question_id, intent, person_id, relative_id, answer) for questions (question_id, person_id, intent) of any of the twenty intents.

    Intents of relatives give a row for each relative (as graph.relatives, or ancestors and descendants
    up to ten steps away, 100 at most); those of properties a row with an answer if it is known. father
    takes any parent, whose gender may be unknown.
    """
    out = asked.where(F.col("intent").isin(*PROPERTIES)).join(persons.select("person_id", F.struct(*(c for c in ("birth_year", "death_year", "birth_place", "biography", "generation"))).alias("p")), "person_id")
    none = F.lit(None)
    rows = out.select("question_id", "intent", "person_id", none.cast("long").alias("relative_id"), property_answer(F.col("p"), F.col("intent")).alias("answer")).where("answer is not null")
    for intent_ in (x for x in INTENTS if x not in PROPERTIES):
        mine = asked.where(F.col("intent") == intent_).select("question_id", "person_id")
        if intent_ in ("ancestor", "descendant"):
            found = lineal(mine.select("person_id").distinct(), parent_of, down=intent_ == "descendant").select(F.col("seed").alias("person_id"), F.col("node").alias("relative_id"))
        else:
            found = relatives(parent_of, spouse_of, persons, "parents" if intent_ == "father" else intent_)
        rows = rows.unionByName(mine.join(found, "person_id").select("question_id", F.lit(intent_).alias("intent"), "person_id", "relative_id", none.cast("string").alias("answer")))
    return rows
