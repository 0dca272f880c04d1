"""The inverted index against reading every entry for every question."""

import random

import pytest

from stemma.operators import postings as P
from stemma.operators import retrieve as T

ENTRY = "entry_id long, title string, type string, text string, page_no int, status string, gram string"


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcd " + chr(0x5F20) + chr(0x738B)) for _ in range(n))
    rows = [(i, r.choice((None, some(6), some(9))), r.choice(("ab", "cd", None)), r.choice((None, "", some(30), some(200))), r.choice((None, r.randrange(5))), r.choice(("active", "active", "archived")), "clash") for i in range(150)]
    asked = [(q, [r.choice((some(1), some(2), some(3), some(5), "ab", "", None, "missing")) for _ in range(r.randrange(5))]) for q in range(40)]
    return spark.createDataFrame(rows, ENTRY).repartition(3), asked


@pytest.mark.parametrize("limit", [1, 12])
def test_like_reading_all(spark, case, limit, tmp_path):
    entries, asked = case
    P.build(entries).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    got = {}
    for x in P.search(entries, index, spark.createDataFrame(asked, "question_id long, tokens array<string>"), limit).collect():
        got.setdefault(x.question_id, []).append((x.r, x.entry_id, x.hits))
    rows = [x for x in entries.collect() if x.status == "active"]
    for q, tokens in asked:
        tokens = [t for t in tokens if t]
        hits = lambda x: sum(2 if t in (x.title or "") or t in (x.type or "") else 1 if t in (x.text or "") else 0 for t in tokens)
        best = sorted((x for x in rows if hits(x)), key=lambda x: (-hits(x), x.page_no or 0, -x.entry_id))[:limit]
        assert sorted(got.get(q, [])) == [(k + 1, x.entry_id, hits(x)) for k, x in enumerate(best)]
        if q < 3 and tokens:
            single = [(x.entry_id, x.hits) for x in T.keyword_search(entries, tokens, limit).collect()]
            assert single == [(x.entry_id, hits(x)) for x in best]


def test_no_rows(spark, case):
    entries, asked = case
    none = entries.limit(0)
    q = spark.createDataFrame(asked, "question_id long, tokens array<string>")
    assert P.search(none, P.build(none), q).count() == 0
    assert P.search(entries, P.build(entries), q.limit(0)).count() == 0
