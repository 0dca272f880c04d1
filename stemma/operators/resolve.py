"""Which records mean the same person: duplicate clusters, ordered merges, chunks of volumes, matching against the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..plans.cut import cut, spread
from .dictionary import occurrences
from .greedy import batched, folded
from .readings import fitted, no_readings, readings_of


def duplicate_clusters(persons: DataFrame) -> DataFrame:
    """(key, keeper, members, n) of people whose names are alike; the smallest id is the default keeper."""
    key = N.duplicate_key(F.col("name"))
    return persons.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min("person_id").alias("keeper"), F.array_sort(F.collect_list("person_id")).alias("members"), F.count("*").alias("n")).where("n >= 2")


def adjudicated(clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clusters (key, n) with verdicts (key, same, keep_index, confidence): missing ones default to the same person, index 0, confidence 0."""
    out = clusters.join(verdicts, "key", "left")
    index = F.when((F.col("keep_index") >= 0) & (F.col("keep_index") < F.col("n")), F.col("keep_index")).otherwise(0)
    return out.withColumns({"same": F.coalesce("same", F.lit(True)), "keep_index": F.coalesce(index, F.lit(0)), "confidence": F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), 2)})


def fuzzy_search(persons: DataFrame, query: str, limit: int = 20, readings: DataFrame | None = None) -> DataFrame:
    """The people whose names fit best, by score, then id; the first ones for an empty query."""
    if not query.strip():
        return persons.withColumn("score", F.lit(0)).orderBy("person_id").limit(limit)
    fits = fitted(persons.select(F.lit(query).alias("query"), "name").distinct(), readings).where("score is not null").select("name", "score")
    return persons.join(fits, "name").select(*persons.columns, "score").orderBy("score", "person_id").limit(limit)


# Words of relationship and asking, taken out of a question, in this order, before names are guessed.
RELATION_WORDS = (
    "父亲", "爸爸", "老爸", "老爹", "爹", "爸爸大人", "父",
    "母亲", "妈妈", "老妈", "老娘", "娘", "母",
    "父母", "双亲",
    "祖父", "爷爷", "爷爷大人", "阿公",
    "祖母", "奶奶", "阿婆",
    "外公", "姥爷",
    "外婆", "姥姥",
    "曾祖父", "太爷爷",
    "曾祖母", "太奶奶",
    "儿子", "儿子们",
    "女儿", "女儿们",
    "子女", "孩子", "儿女", "后人", "后代", "子孙", "孙辈", "辈分",
    "兄弟", "弟兄",
    "哥哥", "大哥", "兄长",
    "弟弟", "小弟",
    "姐姐", "大姐",
    "妹妹", "小妹",
    "姐妹", "姊妹",
    "兄弟姐妹", "同胞",
    "配偶", "另一半",
    "丈夫", "老公", "夫君",
    "妻子", "老婆", "夫人", "太太", "媳妇",
    "祖先", "先祖", "祖宗", "祖辈", "上辈", "长辈",
    "出生地", "籍贯", "故乡", "老家", "家乡", "出生于", "哪里人",
    "生年", "出生年份", "生辰", "生于", "寿命", "享年", "卒年", "去世",
    "简介", "生平", "事迹", "经历",
    "第几代", "辈分", "代数", "世代",
    *"，。？！、,.?!:：的与和了是谁 ",
)


def _one_less(text: Column) -> Column:
    """A text, and what is left of it without one of its characters."""
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))))


def containing(texts: DataFrame, id_col: str, text_col: str, persons: DataFrame) -> DataFrame:
    """(id_col, person_id) for every text and every person whose name stands in it, whole texts, each pair once."""
    own = texts.select(F.col(id_col).cast("long").alias(id_col), text_col)
    search = lambda df: occurrences(df, persons, id_col, text_col, "name").select(id_col, F.col("word").alias("name"))
    # one text finds a name once; only what several texts of an id find is to be made distinct
    again = cut(own.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias("_again")))
    if again.isEmpty():
        found = search(own)
    else:
        same = F.col(id_col).eqNullSafe(F.col("_again"))
        found = search(own.join(again, same, "left_anti")).unionByName(search(own.join(again, same, "left_semi")).distinct())
    return found.join(persons.select("name", "person_id"), "name").select(id_col, "person_id")


def best_matches(queries: DataFrame, persons: DataFrame, readings: DataFrame | None = None) -> DataFrame:
    """(query_id, person_id, name, score): of each query (query_id, query) the person whose name fits best by fitted(), by score, then id.

    Each way to fit has its own join. Queries as parts of names and as beginnings of readings are found by
    automata of the queries, which go once over each name; names read alike meet by their readings, those
    one edit apart by what is left without one character. Nothing is expanded that no query can use, and
    names are never compared with every query.
    """
    asked = queries.select("query_id", N.stripped(F.col("query")).alias("q")).where("q <> ''")
    known = persons.select("person_id", N.stripped(F.col("name")).alias("n")).where("n <> ''")
    table = readings if readings is not None else no_readings(persons)
    plain_q, plain_n = N.plain_letters(F.col("q")), N.plain_letters(F.col("n"))
    words, other = asked.select("q").distinct(), known.where(~plain_n)
    odd = words.where(~plain_q)
    # what several ways need is made once
    read_n = cut(other.join(readings_of(other, table, "n").withColumnRenamed("text", "n"), "n"))
    read_q = cut(readings_of(odd, table, "q").select(F.col("text").alias("q"), F.explode("full").alias("reading")))
    full = read_n.select("person_id", F.explode("full").alias("reading"))
    all_ = full.unionByName(read_n.select("person_id", F.explode("initials").alias("reading")))
    tier = lambda df, score: df.select("q", "person_id", F.lit(score).alias("score"))

    inside = occurrences(known, words, "person_id", "n", "q").withColumnRenamed("word", "q")
    low = words.where(plain_q).withColumn("low", F.lower("q"))
    typed = occurrences(all_, low, "person_id", "reading", "low").where("first = 0").join(low.withColumnRenamed("low", "word"), "word")
    first = read_q.where(F.length("q") == 1).withColumnRenamed("reading", "word")
    begun = occurrences(full, first, "person_id", "reading", "word").where("first = 0").join(first, "word")
    alike = read_q.join(full, "reading")
    less_q = odd.where(F.length("q") >= 2).select("q", F.explode(_one_less(F.col("q"))).alias("less"))
    less_n = other.where(F.length("n") >= 2).select("person_id", "n", F.explode(_one_less(F.col("n"))).alias("less"))
    near = less_q.join(less_n, "less").where(N.edit_distance(F.col("q"), F.col("n"), 1) <= 1)

    pairs = tier(inside, 0).unionByName(tier(typed, 20)).unionByName(tier(begun, 5)).unionByName(tier(alike, 10)).unionByName(tier(near, 30))
    # a name that reads as a query of one character does is no mere beginning
    pairs = pairs.groupBy("q", "person_id").agg(F.min("score").alias("low"), F.max((F.col("score") == 10).cast("int")).alias("alike"))
    pairs = pairs.select("q", "person_id", F.when((F.col("low") == 5) & (F.col("alike") == 1), 10).otherwise(F.col("low")).alias("score"))
    best = pairs.groupBy("q").agg(F.min(F.struct("score", "person_id")).alias("p")).select("q", "p.person_id", "p.score")
    whose = persons.select("person_id", "name").dropDuplicates(["person_id"])
    return asked.join(best, "q").join(whose, "person_id").select("query_id", "person_id", "name", "score")


def mentioned(questions: DataFrame, persons: DataFrame, noise: tuple[str, ...] = RELATION_WORDS, readings: DataFrame | None = None) -> DataFrame:
    """(question_id, person_id, name): the longest name that stands in each question, else the one that fits what is left best.

    An automaton of all names goes once over each question (question_id, question). From questions without
    a name words of noise are taken out, and best_matches() is asked about the rest. Of names alike the
    smallest id counts, of names as long the one of the smallest id.
    """
    named = persons.groupBy("name").agg(F.min("person_id").alias("person_id"))
    found = occurrences(questions, named, "question_id", "question", "name").select("question_id", F.col("word").alias("name")).join(named, "name")
    exact = cut(found.groupBy("question_id").agg(F.max_by(F.struct("person_id", "name"), F.struct(F.length("name"), -F.col("person_id"))).alias("p")).select("question_id", "p.person_id", "p.name"))
    rest = F.coalesce("question", F.lit(""))
    for w in noise:
        rest = F.replace(rest, F.lit(w), F.lit(" "))
    left = cut(questions.join(exact.select("question_id"), "question_id", "left_anti").select(F.col("question_id").alias("query_id"), rest.alias("query")).where(N.stripped(F.col("query")) != ""))
    if left.isEmpty():
        return exact
    return exact.unionByName(best_matches(left, persons, readings).select(F.col("query_id").alias("question_id"), "person_id", "name"))


def matched(new: DataFrame, persons: DataFrame, fill: list[str]) -> DataFrame:
    """New people by name: the oldest known person of that name (by created_at, then id) with what it lacks filled, or a created one.

    new has (name, *fill), persons (person_id, name, created_at, *fill). Returns person_id (null if
    created), name, state and the filled columns; a name occurs once.
    """
    known = persons.withColumn("key", N.graph_key(F.col("name"))).groupBy("key").agg(F.min_by(F.struct("person_id", *fill), F.struct("created_at", "person_id")).alias("k"))
    one = new.withColumn("key", N.graph_key(F.col("name"))).where("key <> ''").groupBy("key").agg(F.min("name").alias("name"), *(F.min(c).alias(c) for c in fill))
    out = one.join(known, "key", "left")
    return out.select(F.col("k.person_id").alias("person_id"), "name", F.when(F.col("k").isNull(), "created").otherwise("matched").alias("state"), *(F.coalesce(F.col(f"k.{c}"), F.col(c)).alias(c) for c in fill))


# How a page is written down for consolidation.
PAGE, PEOPLE, BODY, NOTES = "第{}页", "人物:", "谱文({}):", "备注:"
MALE, FEMALE, BORN, DIED, FROM, LIFE = "男", "女", "生", "卒", "籍", "迹:"


def body_text(content: Column) -> Column:
    """What rendered() shows of a page's paragraphs; content that many pages share is to be cut once, before it is joined to them."""
    kept = F.filter(F.transform(F.slice(F.coalesce(content, F.array().cast("array<string>")), 1, 8), N.stripped), lambda t: t != "")
    before, after = BODY.split("{}")
    body = F.transform(kept, lambda t, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), F.substring(t, 1, 300)))
    return F.array_join(body, "\n")


def rendered(page_no: Column, persons: Column, content: Column | None, notes: Column, body: Column | None = None) -> Column:
    """A page as text for consolidation: number, 40 people at most, of the first 8 paragraphs those that are not empty, 300 characters of each, 80 of the notes.

    Instead of content there may be a body that body_text() has made of it.
    """
    some = lambda c: F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))
    year = lambda c: F.nullif(c, F.lit(0)).cast("string")
    put = lambda mark, c: F.concat(F.lit(mark), c)
    one = lambda p: F.concat_ws("、", N.stripped(p["name"]), F.when(p["gender"] == "male", MALE).when(p["gender"] == "female", FEMALE), put(BORN, year(p["birth_year"])), put(DIED, year(p["death_year"])), put(FROM, some(p["birth_place"])), put(LIFE, some(p["biography"])))
    who = F.when(F.size(persons) > 0, put(PEOPLE, F.array_join(F.transform(F.slice(persons, 1, 40), one), "；")))
    body = body if body is not None else body_text(content)
    before, after = PAGE.split("{}")
    head = F.concat(F.lit(before), F.coalesce(page_no, F.lit(0)).cast("string"), F.lit(after))
    return F.concat_ws("\n", head, who, F.nullif(body, F.lit("")), put(NOTES, F.substring(some(notes), 1, 80)))


def consolidated_people(rows: DataFrame) -> DataFrame:
    """One row for each name of a task, from (task_id, page_no, name, gender, birth_year, birth_place, confidence).

    Attributes come from the first page that has them, gender from the first that knows it; pages are the
    sorted set, confidence the largest.
    """
    has = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("page_no"))
    keyed = rows.withColumn("key", N.tight(F.col("name"))).where("key <> ''")
    return keyed.groupBy("task_id", "key").agg(
        F.min_by("name", "page_no").alias("name"), F.coalesce(F.min_by("gender", F.when(F.col("gender").isin("male", "female"), F.col("page_no"))), F.lit("unknown")).alias("gender"),
        F.min_by("birth_year", has("birth_year")).alias("birth_year"), F.min_by("birth_place", has("birth_place")).alias("birth_place"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("page_no")).alias("pages"),
    ).drop("key")


def consolidated_relations(rows: DataFrame) -> DataFrame:
    """One row for each (task_id, type, from, to) by tight names, with the pages and the largest confidence; other types go."""
    keyed = rows.where(F.col("type").isin("parent_child", "spouse")).withColumns({"fk": N.tight(F.col("from_name")), "tk": N.tight(F.col("to_name"))}).where("fk <> '' and tk <> ''")
    return keyed.groupBy("task_id", "type", "fk", "tk").agg(F.min("from_name").alias("from_name"), F.min("to_name").alias("to_name"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.max("confidence").alias("confidence")).drop("fk", "tk")


def accepted_merges(merges: DataFrame, least: float = 0.9) -> DataFrame:
    """(task_id, drop, keep, place) of merges (task_id, ord, keep, drop, confidence) sure enough, in order and without chains.

    A merge is skipped if its names are equal or empty, or if either of them is dropped already; what has
    taken others in may still be dropped itself.
    """

    def begin(key: tuple):
        dropped: set[str] = set()

        def step(row: tuple) -> Iterator[tuple]:
            _, _, keep, drop = row
            if keep and drop and keep != drop and drop not in dropped and keep not in dropped:
                dropped.add(drop)
                yield key[0], drop, keep, len(dropped)

        return step, tuple

    sure = merges.where(F.col("confidence") >= least).select("task_id", "ord", "keep", "drop")
    return folded(sure, ["task_id"], ["ord"], "task_id long, drop string, keep string, place int", begin)


def merged_persons(persons: DataFrame, merges: DataFrame) -> DataFrame:
    """Consolidated people (task_id, name, gender, birth_year, death_year, birth_place, biography, confidence, pages) after accepted merges.

    Who is kept takes what they lack from those merged into them, in order of the merges, with what these
    have taken in themselves; all pages, the largest confidence, and a gender if theirs is unknown.
    """

    def begin(key: tuple):
        into: dict[str, list[str]] = {}

        def step(row: tuple) -> tuple:
            into.setdefault(row[3], []).append(row[2])
            return ()

        def end() -> Iterator[tuple]:
            gone = {x for v in into.values() for x in v}
            for root in into:
                if root in gone:
                    continue
                todo, place = [root], 0
                while todo:  # whoever is taken in brings along at once whom they have taken in
                    x = todo.pop()
                    yield key[0], x, root, place
                    place += 1
                    todo += reversed(into.get(x, ()))

        return step, end

    order = folded(merges.select("task_id", "place", "drop", "keep"), ["task_id"], ["place"], "task_id long, name string, root string, place int", begin)
    rows = persons.join(order, ["task_id", "name"], "left").withColumns({"root": F.coalesce("root", "name"), "place": F.coalesce("place", F.lit(0))})
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("place"))).alias(c)
    gender = F.coalesce(F.min_by("gender", F.when(F.col("gender").isin("male", "female"), F.col("place"))), F.lit("unknown"))
    return rows.groupBy("task_id", "root").agg(gender.alias("gender"), *map(first, ("birth_year", "death_year", "birth_place", "biography")), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.max("confidence"), F.lit(0.0)))), 2).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")).withColumnRenamed("root", "name")


def person_brief(number: Column, p: Column) -> Column:
    """One line about a person for the question who is the same: number, name, gender, years, birth place (16), first page, biography (40)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    years = F.regexp_replace(F.concat(text(F.nullif(p["birth_year"], F.lit(0))), F.lit("~"), text(F.nullif(p["death_year"], F.lit(0)))), "^~+|~+$", "")
    gender = F.when(p["gender"] == "male", "男").when(p["gender"] == "female", "女").otherwise("")
    page = F.when(F.size(p["pages"]) > 0, F.concat(F.lit("页"), F.array_min(p["pages"]).cast("string"))).otherwise("")
    return F.concat_ws("|", text(number), text(p["name"]), gender, years, F.substring(text(p["birth_place"]), 1, 16), page, F.substring(F.replace(text(p["biography"]), F.lit("\n"), F.lit("")), 1, 40))


def disambiguation_batches(people: DataFrame, least: int = 200, most_chars: int = 6000) -> DataFrame:
    """(task_id, number, brief, batch) of people (task_id, number, brief): lines of a volume in batches of at most so many characters; volumes of fewer than `least` people are left out."""
    large = people.groupBy("task_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("task_id")
    rows = people.join(large, "task_id", "left_semi").select("task_id", "number", "brief", F.length("brief").cast("long").alias("chars"))
    return batched(rows, ["task_id"], ["number"], "chars", None, most_chars).drop("chars")


def sure_verdicts(verdicts: DataFrame, counts: DataFrame, least: float = 0.9) -> DataFrame:
    """Verdicts (task_id, duplicate_index, keep_index, confidence) that are sure enough, on two different people that the volume (task_id, n) has."""
    fine = verdicts.where(F.coalesce("confidence", F.lit(0.0)) >= least).where("duplicate_index <> keep_index and duplicate_index >= 0 and keep_index >= 0")
    return fine.join(counts, "task_id").where("duplicate_index < n and keep_index < n").drop("n").withColumn("confidence", F.bround(F.least(F.lit(1.0), "confidence"), 2))


def renamed_relations(relations: DataFrame, merges: DataFrame) -> DataFrame:
    """Relations (task_id, type, from_name, to_name) after merges: ends renamed once, loops and empty ends dropped, each triple once, all by tight names."""
    tight = lambda c: N.tight(F.col(c))
    a, b = (merges.select("task_id", tight("drop").alias(k), F.col("keep").alias(f"new_{k}")) for k in ("fk", "tk"))
    rows = relations.count()
    a, b, own = (spread(df, rows, "task_id") for df in (a, b, relations))
    out = own.withColumns({"fk": tight("from_name"), "tk": tight("to_name")}).join(a, ["task_id", "fk"], "left").join(b, ["task_id", "tk"], "left")
    out = out.select("task_id", "type", F.coalesce("new_fk", "from_name").alias("from_name"), F.coalesce("new_tk", "to_name").alias("to_name"))
    keyed = out.withColumns({"fk": tight("from_name"), "tk": tight("to_name")}).where("fk <> '' and tk <> '' and fk <> tk")
    return keyed.groupBy("task_id", "type", "fk", "tk").agg(F.min("from_name").alias("from_name"), F.min("to_name").alias("to_name")).drop("fk", "tk")


def evidence_pages(people: DataFrame) -> DataFrame:
    """(task_id, key, pages): on which pages each name occurs."""
    return people.withColumn("key", N.tight(F.col("name"))).where("key <> ''").groupBy("task_id", "key").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def needs_consolidation(status: Column, stale: Column, consolidated: Column, pages: Column, relations: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.coalesce(stale, F.lit(False)) | (no(consolidated) & (F.coalesce(pages, F.lit(0)) > 0) & (F.coalesce(relations, F.lit(0)) == 0) & (status == "done"))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_scorer(query: pd.Series, text: pd.Series) -> pd.Series:
    """Offline stand-in for a reranking model: share of the query's words that the text has."""
    out = []
    for q, t in zip(query, text, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return pd.Series(out, dtype=float)


def scored(pairs: DataFrame, query: str, text: str, scorer: Scorer = overlap_scorer, to: str = "score") -> DataFrame:
    """pairs with a score from a model that takes batches of (query, text)."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return scorer(q, t)

    return pairs.withColumn(to, run(F.col(query), F.col(text)))
