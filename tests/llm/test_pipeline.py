"""The corpus pipeline as a whole, on ids that are null or repeated."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
from stemma.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def test_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    stay = [(i, prose(r, r.randint(20, 60))) for i in range(30)] + [(None, prose(r, 30)) for _ in range(12)] + [(7, prose(r, 50))]
    copies = [stay[5]] * 3 + [(60, stay[-1][1]), (61, stay[-1][1] + " more"), (62, stay[7][1]), (63, stay[7][1])]
    table(spark, stay + copies).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((x["doc_id"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = {(i, hashlib.sha256(t.encode()).hexdigest()): len(t.split()) for i, t in stay}
    assert set(got) == set(want) and len(want) == len(stay)
    # one source: 1.5 times its words, each row once or twice
    assert set(got.values()) == {1, 2}
    assert abs(sum(n * want[x] for x, n in got.items()) - 1.5 * sum(want.values())) <= 60


def test_copies_of_null_and_repeated_ids(spark):
    r = random.Random(5)
    rows = [(None, prose(r, 10)) for _ in range(50)] + [(3, prose(r, 8)) for _ in range(20)] + [(4, "the same text")] * 9 + [(5, None), (None, ""), (6, "one two")]
    df = table(spark, rows)
    mixed = mixing.mix(df)
    got = Counter((x["doc_id"], x["text"]) for x in mixing.repeat_rows(df, mixed).collect())
    of = lambda rows: Counter(i for i, n in rows for _ in range(n))
    assert of((i, n) for (i, _), n in got.items()) == of((x["doc_id"], x["copies"]) for x in mixed.collect())
    assert all(1 <= n <= 2 for (i, t), n in got.items() if i != 4) and 9 <= got[4, "the same text"] <= 18
    assert got == Counter((x["doc_id"], x["text"]) for x in mixing.repeat_rows(df.repartition(5), mixing.mix(df.repartition(2))).collect())


def test_many_rows_alike_are_one_group_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    rows = [(None, "one two three")] * 5000 + [(i, prose(random.Random(i), 5)) for i in range(300)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and {x["copies"] for x in got if x["doc_id"] is None} == {1, 2}
    total = 5000 * 3 + 300 * 5
    assert abs(sum(x["taken"] for x in got) - 1.5 * total) <= 5 and all(x["source_size"] == total for x in got)


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
