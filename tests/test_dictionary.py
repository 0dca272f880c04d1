"""Words in texts against plain search, in one automaton and in shards and blocks."""

import random

import pytest

from stemma.operators import dictionary as D
from stemma.operators import resolve as S


@pytest.fixture(scope="module")
def case():
    r = random.Random(6)
    some = lambda n: "".join(r.choice("ab" + chr(0x5F20) + chr(0x1F600) + " ") for _ in range(n))
    words = ["", None, "a", "a", "ab", "missing", *(some(r.randint(1, 6)) for _ in range(200))]
    texts = [(i, some(r.randint(0, 120))) for i in range(80)] + [(3, "a again"), (None, "ab"), (900, None), (901, ""), (902, "ab" * 50_000)]
    return words, texts


@pytest.mark.parametrize("shard,block", [(D.SHARD, D.BLOCK), (40, 1000), (200, 1 << 30)])
def test_occurrences(spark, case, shard, block):
    words, texts = case
    w = spark.createDataFrame([(x, 1) for x in words], "word string, text int")
    t = spark.createDataFrame([(*x, "clash", 1) for x in texts], "key long, body string, word string, shard int").repartition(3)
    got = sorted(map(repr, map(tuple, D.occurrences(t, w, "key", "body", "word", shard, block).collect())))
    want = []
    for i, text in texts:
        for x in {x for x in words if x}:
            places = [k for k in range(len(text or "")) if text.startswith(x, k)] if x in (text or "") else []
            want += [(i, x, places[0], len(places))] if places else []
    assert got == sorted(map(repr, want))


def test_no_rows(spark, case):
    none, some = spark.createDataFrame([], "key long, word string"), spark.createDataFrame([(1, "a")], "key long, word string")
    for texts, words in ((none, some), (some, none), (none, none)):
        assert D.occurrences(texts, words, "key", "word", "word").count() == 0


def test_containing(spark):
    texts = spark.createDataFrame([(1, "anna and ann"), (2, None), (3, "bob")], "id long, body string")
    people = spark.createDataFrame([(10, "ann"), (11, "ann"), (12, "anna"), (13, None), (14, "")], "person_id long, name string")
    assert sorted(map(tuple, S.containing(texts, "id", "body", people).collect())) == [(1, 10), (1, 11), (1, 12)]
