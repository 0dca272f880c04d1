"""Finding all words of a table in all texts of another one, by Aho-Corasick automata.

An automaton goes once over a text, however many words it knows. Words whose characters fit in one
automaton are sent to all tasks; of more, each shard has an automaton of its own and meets the texts
block by block, so neither the words nor the texts are ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import on_workers

#: Characters of the words of one automaton, some 40 bytes each, and of the texts of a block.
SHARD, BLOCK = 2 << 20, 64 << 20
#: Rows of a batch that leaves an automaton, but for a text that has more by itself.
BATCH = 50_000

_FOUND = "text string, word string, first long, n long"


def _automaton(words: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _found(automaton, ids: list, texts: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], names=names)
    rows: tuple[list, list, list, list] = [], [], [], []
    for i, text in zip(ids, texts, strict=True):
        if len(rows[0]) >= BATCH:
            yield batch()
            rows = [], [], [], []
        seen: dict[str, list[int]] = {}
        for end, word in automaton.iter(text):
            if word in seen:
                seen[word][1] += 1
            else:
                seen[word] = [end - len(word) + 1, 1]
        rows[0].extend([i] * len(seen))
        rows[1].extend(seen)
        rows[2].extend(v[0] for v in seen.values())
        rows[3].extend(v[1] for v in seen.values())
    yield batch()


def occurrences(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, word_col: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(id_col, word, first, n): for each row of texts and each word that stands in its whole text, the first place (from 0) and how often.

    Words are compared as they stand; overlapping ones all count. Null and empty words and texts find
    nothing, words that are repeated count once, rows of texts that are repeated each give their own
    rows. Ids are longs. shard and block bound what is held at once.
    """
    spark = texts.sparkSession
    on_workers(spark)
    own = words.select(F.col(word_col).cast("string").alias("word")).where("word <> ''").distinct()
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    names = [id_col, "word", "first", "n"]
    schema = f"`{id_col}` long, word string, first long, n long"
    held = own.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(held / shard))
    if shards == 1:
        sent = spark.sparkContext.broadcast(sorted(r["word"] for r in own.collect()))  # `shard` characters at most

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value) if sent.value else None
            for b in batches:
                if automaton is not None and b.num_rows:
                    yield from _found(automaton, b.column(0).to_pylist(), b.column(1).to_pylist(), names)

        return rows.mapInArrow(whole, schema)

    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / block))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # each word goes to all blocks of its shard, each text to its block of all shards
    left = own.select(F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), number(blocks).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("word").alias("text"))
    right = rows.select(number(shards).alias("shard"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "text")

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, automaton = None, [], None
        for b in batches:
            rows_ = list(zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True))
            ids, texts_ = [], []
            for s, k, kind, i, text in rows_:
                if (s, k) != key:
                    if ids:
                        yield from _found(automaton, ids, texts_, names)
                        ids, texts_ = [], []
                    key, held, automaton = (s, k), [], None
                if kind == 0:
                    held.append(text)
                    continue
                if automaton is None and held:
                    automaton, held = _automaton(held), []
                if automaton is not None:
                    ids.append(i)
                    texts_.append(text)
            if ids:
                yield from _found(automaton, ids, texts_, names)

    both = left.unionByName(right)
    return both.repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(blockwise, schema)
