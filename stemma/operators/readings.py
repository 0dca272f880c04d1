"""How names are read, from a table of characters and their readings, and names that fit what is typed.

The table has (char, reading) and may have ord, the order of a character's readings; it is joined, so
plans are as large for thirty thousand characters as for ten. A name with characters of several
readings has all their combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

#: Combinations of readings that a text has at most; where there would be more, further characters have their first reading only.
COMBINATIONS = 256


def readings_of(texts: DataFrame, table: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, full, initials) for each distinct text: its readings, lower case, and their first letters, as arrays without repeats.

    White space is not read. Ideographs that the table lacks stand for themselves, other characters that
    it lacks are left out; what is then empty is no reading. Null and empty texts have no row.
    """
    order = F.col("ord") if "ord" in table.columns else F.lit(0)
    known = table.select("char", F.lower("reading").alias("reading"), order.alias("ord")).where("reading <> ''")
    ranked = F.array_sort(F.collect_set(F.struct("ord", "reading")))
    known = known.groupBy("char").agg(F.array_distinct(F.transform(ranked, lambda r: r["reading"])).alias("ways"))  # a row for each character: there are 1,114,112 at most
    own = texts.select(F.col(text_col).alias("text")).where("text <> ''").distinct()
    chars = own.select("text", F.posexplode(F.split(N.tight(F.col("text")), "")).alias("place", "char"))
    alone = F.when(F.col("char").rlike(r"\p{IsHan}"), F.array("char")).otherwise(F.array(F.lit("")))
    read = chars.join(F.broadcast(known), "char", "left").select("text", "place", F.coalesce("ways", alone).alias("ways"))
    lattice = read.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ways"))), lambda x: x["ways"]).alias("lattice"))
    longer = lambda held, ways: F.flatten(F.transform(held, lambda h: F.transform(ways, lambda w: F.struct(F.concat(h["full"], w).alias("full"), F.concat(h["initials"], F.substring(w, 1, 1)).alias("initials")))))
    step = lambda held, ways: F.when(F.size(held) * F.size(ways) <= COMBINATIONS, longer(held, ways)).otherwise(longer(held, F.slice(ways, 1, 1)))
    all_ = F.aggregate("lattice", F.array(F.struct(F.lit("").alias("full"), F.lit("").alias("initials"))), step)
    part = lambda name: F.filter(F.array_distinct(F.transform("ways", lambda w: w[name])), lambda x: x != "").alias(name)
    return lattice.select("text", all_.alias("ways")).select("text", part("full"), part("initials"))


def no_readings(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "char string, reading string")


def _begins(ways: Column, start: Column) -> Column:
    return F.exists(ways, lambda w: F.startswith(w, start))


def fitted(pairs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """pairs (query, name, ...) with score: how well a name fits a query, lower is better, null for no fit.

    0: the name contains it as it stands. 20: a query in plain letters begins a reading or the initials
    of a name that is not in plain letters. Of two that are not in plain letters, 10: a reading of both
    is alike; 5: a reading of the name begins with one of a query of one character; 30: at most one edit
    apart, two characters or more each. White space at the ends does not count.
    """
    q, n = N.stripped(F.col("query")), N.stripped(F.col("name"))
    rows = pairs.withColumns({"_q": q, "_n": n})
    both = rows.select(F.explode(F.array("_q", "_n")).alias("text")).where(~N.plain_letters(F.col("text")))
    read = readings_of(both, table if table is not None else no_readings(pairs))
    for side in ("_q", "_n"):
        rows = rows.join(read.select(F.col("text").alias(side), F.col("full").alias(f"{side}_full"), F.col("initials").alias(f"{side}_initials")), side, "left")
        rows = rows.withColumn(side, _legible(*(F.col(c) for c in (side, f"{side}_full", f"{side}_initials"))))
    return rows.withColumn("score", fit(F.col("_q"), F.col("_n"))).select(*pairs.columns, "score")


def legible(rows: DataFrame, text_col: str, table: DataFrame, to: str) -> DataFrame:
    """rows with what fit() looks at of a text (to), which is made once for each row: worth it where a row is in many pairs."""
    own = rows.withColumn("_text", N.stripped(F.col(text_col)))
    read = readings_of(own.where(~N.plain_letters(F.col("_text"))), table, "_text").select(F.col("text").alias("_text"), F.col("full").alias("_full"), F.col("initials").alias("_initials"))
    return own.join(read, "_text", "left").select(*(c for c in rows.columns if c != to), _legible(F.col("_text"), F.col("_full"), F.col("_initials")).alias(to))


def _legible(text: Column, full: Column, initials: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(text.alias("text"), N.plain_letters(text).alias("plain"), F.coalesce(full, none).alias("full"), F.coalesce(initials, none).alias("initials"))


def fit(query: Column, name: Column) -> Column:
    """The score that fitted() tells of, of two that legible() has made."""
    q, n, low = query["text"], name["text"], F.lower(query["text"])
    return (
        F.when((q == "") | (n == ""), F.lit(None).cast("int"))
        .when(F.contains(n, q), 0)
        .when(name["plain"], F.lit(None).cast("int"))
        .when(query["plain"], F.when(_begins(name["initials"], low) | _begins(name["full"], low), 20))
        .when(F.arrays_overlap(name["full"], query["full"]), 10)
        .when(F.length(q) == 1, F.when(F.exists(query["full"], lambda r: _begins(name["full"], r)), 5))
        .when((F.length(n) >= 2) & (N.edit_distance(q, n, 1) <= 1), 30)
    )


def reading_index(persons: DataFrame, table: DataFrame) -> DataFrame:
    """(reading, kind, person_id, name): an index to be kept as Parquet, sorted, so that begun() reads only the files and row groups of a beginning.

    kind is full or initials; names in plain letters have no rows. Names alike are read once.
    """
    own = persons.select("person_id", "name", N.stripped(F.col("name")).alias("text")).where((F.col("text") != "") & ~N.plain_letters(F.col("text")))
    read = own.join(readings_of(own, table), "text")
    rows = [read.select(F.explode(kind).alias("reading"), F.lit(kind).alias("kind"), "person_id", "name") for kind in ("full", "initials")]
    return rows[0].unionByName(rows[1]).repartitionByRange("reading").sortWithinPartitions("reading", "person_id")


def begun(index: DataFrame, query: str) -> DataFrame:
    """(person_id, name) of the people in an index one of whose readings or initials begins with a query, each once."""
    low = query.strip().lower()
    found = index.where(F.col("reading") >= low)
    return found.where(F.col("reading") < low + chr(0x10FFFF)).where(F.startswith("reading", F.lit(low))).select("person_id", "name").distinct()
