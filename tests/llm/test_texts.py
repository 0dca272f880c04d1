"""Corpus operators on small tables: nulls, empty and long texts, repeated rows, no rows, extra columns, and brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import chunks, edit_fingerprint, html_crf, minmax, mixing, piece_bpe, radix_dedup, secrets, substring_dedup, toxicity
from stemma.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, kind string, n long, label string"
WORDS = "the of a to in is it on for as with by at from this that be are was or an one two three alpha beta gamma delta".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(("", "", ",", ".")) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, empty, null and long texts."""
    r = random.Random(8)
    base, passage = prose(r, 120), prose(r, 40)
    out = [base, base, base.replace("alpha", "omega"), "", None, "x", passage, passage + " tail", "a" * 400, "ab" * 300, "é" * 90 + passage]
    for i in range(40):
        words = base.split()
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = r.choice(("new", "word"))
        out.append(" ".join(words))
        out.append(prose(r, r.randint(0, 80)) + (" " + passage if i % 3 == 0 else "") + "\n" + prose(r, r.randint(0, 30)))
    out.append(prose(r, 6000) + " " + passage)
    return [(i * 3, t) for i, t in enumerate(out)]


def table(spark, rows, extra=True):
    return spark.createDataFrame([(i, t, None if i is None or i % 4 == 0 else f"s{i % 3}", "kind", 7, "label") for i, t in rows], SCHEMA).repartition(3)


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


OPERATORS = {
    "secrets": secrets.digests,
    "fingerprint": edit_fingerprint.against_edits,
    "mix": mixing.mix,
    "pieces": lambda d: piece_bpe.encode(d, tokenizer_path(), digests=True),
    "windows": substring_dedup.remove_repeats,
    "near": minmax.near_duplicates,
    "bytes": radix_dedup.remove_repeats,
    "toxic": lambda d: toxicity.score(d, toxicity.never()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = [(1, None), (1, None), (2, ""), (None, "some words of a text"), (None, None), (3, "x"), (3, "x"), (4, " \n\t ")]
    out = OPERATORS[name](table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 1, 2, 3, 3, 4]


def test_pieces_like_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rows = [*texts, (1000, "  two  spaces "), (1001, "▁ literal ▁▁ marks"), (1002, "\x00\t\n tabs"), (1003, "日本語 😀 Ω"), (1004, "a　b c"), (1005, "<s> <0x0A> ⁇"), (1006, " " * 40)]
    got = {r["doc_id"]: r for r in OPERATORS["pieces"](table(spark, rows)).collect()}
    plain = {r["doc_id"]: r for r in piece_bpe.encode(table(spark, rows), tokenizer_path()).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert plain[i]["ids"] == ids and plain[i]["decoded"] == sp.decode(ids)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    back = piece_bpe.decode(piece_bpe.encode(table(spark, rows), tokenizer_path()), tokenizer_path())
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: plain[i]["decoded"] for i, _ in rows}


def test_backtracking_on_random_texts():
    import sentencepiece

    own, sp, r = piece_bpe.encoder(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), random.Random(1)
    for _ in range(1500):
        t = "".join(r.choice("abehinorst  ,.'\"ABE01é\n▁") for _ in range(r.randint(0, 40)))
        assert own.encode(t) == sp.encode(t), t


@pytest.mark.parametrize("memory", [3000, piece_bpe.MEMORY])
def test_digests_on_random_texts(memory):
    import sentencepiece

    own, sp, r = piece_bpe.MergeEncoder(tokenizer_path(), memory), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), random.Random(3)
    for n in range(1500):
        t = "".join(r.choice("abehinorst  ,.'\"ABE01é\n▁日本😀\x00ßü\u3000") for _ in range(r.randint(0, 60))) * (8 if n % 50 == 0 else 1)
        ids = sp.encode(t)
        assert own.digest(t) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), t
    assert own.ids_of.size <= memory


@pytest.mark.parametrize("text", ["日本語" * 1_700_000, "ab" * 2_500_000, "word, " * 800_000], ids=["ideographs", "letters", "words"])
def test_texts_of_5_mb(text):
    import sentencepiece

    own, sp = piece_bpe.MergeEncoder(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    n, ids, decoded = own.digest(text)
    want = sp.encode(text)
    assert (n, ids, decoded) == (len(want), sha(",".join(map(str, want))), sha(text))
    own.digest("")
    assert sum(map(len, own.ids_of)) < 200  # no text is remembered as a word


@pytest.mark.parametrize("small", [False, True])
def test_windows_against_brute_force(spark, texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)
        monkeypatch.setattr(chunks, "SHARD_KEYS", 500)
    got = {r["doc_id"]: r for r in OPERATORS["windows"](table(spark, texts)).collect()}
    first, split = {}, {i: (t or "").encode().split() for i, t in texts}
    for i, w in sorted(split.items()):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), sha(left))
        assert got[i]["kept"].encode() == left


@pytest.mark.parametrize("small", [False, True])
def test_bytes_against_brute_force(spark, texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)
        monkeypatch.setattr(chunks, "SHARD_KEYS", 500)
        monkeypatch.setattr(radix_dedup, "HOT", 4)
    got = {r["doc_id"]: r for r in OPERATORS["bytes"](table(spark, texts)).collect()}
    first, raw = {}, {i: (t or "").encode() for i, t in texts}
    for i, b in sorted(raw.items()):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(left))
        assert bytes(got[i]["kept"]) == left


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [False, True])
def test_near_against_brute_force(spark, texts, monkeypatch, small):
    if small:
        monkeypatch.setattr(minmax, "SMALL", 2)
        monkeypatch.setattr(minmax, "NEAR", 1)
        monkeypatch.setattr(minmax, "FEW", 2)
        monkeypatch.setattr(minmax, "LOT", 5)
        monkeypatch.setattr(minmax, "SIDE", 3)
    got = {r["doc_id"]: r for r in OPERATORS["near"](table(spark, texts)).collect()}
    sets = {}
    for i, t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert {r["doc_id"] for r in minmax.one_of_each(table(spark, texts)).collect()} == {i for i in sets if want[i] == i}


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(0, 40)), (None, "a", "b", "c")[0 if i < 5 else 1 + int(r.random() ** 3 * 3)]) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id")["taken"].tolist()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in (None, "a", "b", "c")}
    weight, left, target = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(size.values()), {}
    while len(target) < 4:
        open_ = [s for s in size if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        if not full:
            target |= share
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
    for s, want in target.items():
        own = got[got["source"].isna() if s is None else got["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(want) and own["source_size"].iloc[0] == size[s]
        assert abs(own["taken"].sum() - want) <= 45  # one document
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    repeated = mixing.repeat_rows(df, mixing.mix(df))
    assert repeated.count() == got["copies"].sum() and repeated.columns == df.columns


def test_secrets_base_and_net(spark):
    hexes, key = "0123456789abcdef01234567", "AKIA" + "Q" * 16
    texts = {1: f"password: {key} and {hexes}", 2: 'é😀 API_KEY="abc123xyz"', 3: "secret=abc token=longer.value", 4: f"AKIAQ {key[:19]}", 5: "ſecret: abcdefgh plain words only", 6: None, 7: "password:token =abcdefgh"}
    got = {r["doc_id"]: r for r in secrets.digests(table(spark, list(texts.items()))).collect()}
    base = lambda i: [s for s in got[i]["spans"].split(",") if s and not s.startswith("net")]
    assert base(1) == ["assign:0:30", "access:10:30", "hex:35:59"]
    assert base(2) == ["assign:3:21"] and base(3) == ["assign:11:29"] and base(4) == base(5) == base(6) == base(7) == []
    assert all(got[i]["base_sha256"] == sha(",".join(base(i))) for i in texts)
    net = secrets.trained_network()
    held = secrets.labelled_findings(600, seed=77)
    scores = [(net.score(secrets.Network.symbols(secrets._classes(t), a, b)) >= net.threshold, y) for t, a, b, y in held]
    assert sum(s for s, y in scores if y) >= 0.95 * sum(y for _, y in scores) and sum(s for s, y in scores if not y) <= 3
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"
    assert secrets.find(f"see {token} here", net)[0][2] == "net"
    out = secrets.redact(table(spark, [(1, f"é key {token} and password=hunter22x"), (2, None), (3, "clean text")]), length_col="n").collect()
    assert {r["doc_id"]: (r["text"], r["n"]) for r in out} == {1: ("é key [secret] and [secret]", 27), 2: (None, None), 3: ("clean text", 10)}


def test_toxicity_held_out(spark):
    r = random.Random(4)
    bad = ["idiot", "moron", "scum", "trash", "pathetic", "worthless"]
    rows = []
    for i in range(900):
        w = prose(r, r.randint(10, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad).upper() if r.random() < 0.2 else r.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y if i % 50 == 7 else y, None if i % 9 == 0 else 1 - (i % 5 == 1)) for i, _, y in rows[:600]] + [(5000, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    held = rows[600:]
    assert sum(got[i]["rejected"] == bool(y) for i, _, y in held) >= len(held) - 3
    assert {x["doc_id"] for x in toxicity.keep_clean(docs, chain).collect()} == {i for i, x in got.items() if not x["rejected"]}
    assert not any(x["rejected"] for x in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect())
    # nothing to learn from, and columns of other names and of clashing ones
    none = toxicity.fit(docs.limit(0), labels)
    assert none.threshold > 1 and toxicity.fit(docs, labels.limit(0)).threshold > 1
    wide = docs.selectExpr("doc_id", "text", "'x' as y", "1 as q", "0 as toxic", "'z' as own")
    assert np.allclose(toxicity.fit(wide, labels.selectExpr("doc_id", "toxic", "quality", "'t' as text", "2 as h")).table, chain.table)


def test_chain_of_degrees(spark):
    """Later links see earlier ones, and degrees come from labelled rows alone."""
    r = random.Random(6)
    rows = []
    for i in range(600):
        w, n = prose(r, 30).split(), (0, 0, 1, 5)[i % 4]
        rows.append((i, " ".join(w + ["slur" + k for k in r.sample("abcdef", n)]), int(n > 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int"))
    got = chain.probabilities([t for _, t, _ in rows])
    assert [len(x) for x in chain.links] == [1, 2, 3, 4]
    five, single, clean = (got[k::4].mean(0) for k in (3, 2, 1))
    assert five[2] > 0.7 > single[2] and single[3] > 0.6 > clean[3]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_features_of_long_texts(n):
    text = " ".join(["Ünter-Wort99 abc"] * n)
    own, sizes = toxicity.features([text, "", text.upper()])
    assert sizes.tolist() == [min(3, 3 * n), 0, min(3, 3 * n)] and own[: sizes[0]].tolist() == own[sizes[0] :].tolist()


def test_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in edit_fingerprint.against_edits(table(spark, texts)).collect()}
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == sha(edited)
        assert got[i]["fingerprint"] == edit_fingerprint.embed([t])[0][0] and got[i]["edited_fingerprint"] == edit_fingerprint.embed([edited])[0][0]
        assert got[i]["near_next"] == edit_fingerprint.likeness(got[i]["fingerprint"], got[order[(k + 1) % len(order)][0]]["fingerprint"])
    long = [x for x in got.values() if x["n_chars"] > 300 and x["near_edited"] < 1]
    assert sum(x["near_edited"] for x in long) / len(long) > 0.5
    assert edit_fingerprint.likeness(*edit_fingerprint.embed(["abc", "abc"])[0]) == 1.0
    r = random.Random(6)
    t = prose(r, 400)
    near, far = t[:500] + "inserted" + t[500:], prose(r, 400)
    a, b, c = edit_fingerprint.embed([t, near, far])[0]
    assert edit_fingerprint.likeness(a, b) > 0.5 > 0.25 > edit_fingerprint.likeness(a, c)


def test_fingerprints_in_chunks(spark, texts, monkeypatch):
    one = {r["doc_id"]: r for r in edit_fingerprint.against_edits(table(spark, texts)).collect()}
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 5000)
    assert {r["doc_id"]: r for r in edit_fingerprint.against_edits(table(spark, texts)).collect()} == one


def test_fingerprints_send_whole_texts_once(spark, texts):
    lines = edit_fingerprint.against_edits(table(spark, texts))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("MapInArrow" in x and "texts#" in x for x in lines) == 1


def test_edit_near_duplicates(spark):
    r = random.Random(9)
    base = [prose(r, 80) for _ in range(6)]
    rows = [(10 * i + k, t if k < 2 else t[:-3] + "xyz") for i, t in enumerate(base) for k in range(3)]
    got = {x["doc_id"]: x["class_id"] for x in edit_fingerprint.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


@pytest.mark.parametrize("small", [False, True])
def test_edit_classes_against_brute_force(spark, texts, monkeypatch, small):
    """Whole buckets: all that agree on a band and are alike, in buckets of a shared header too."""
    if small:
        for name in ("SMALL", "NEAR", "LOT", "FEW"):
            monkeypatch.setattr(edit_fingerprint, name, 2)
    r = random.Random(12)
    header, rows = prose(r, 60), list(texts)
    for i in range(1000, 1060):
        rows.append((i, header + "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700))))
    for i, j in ((10, 30), (20, 50), (5, 45)):
        t = list(dict(rows)[1000 + i])
        t[900:904] = "####"
        rows[len(texts) + j] = (1000 + j, "".join(t))
    prints = {i: f for (i, _), f in zip(rows, edit_fingerprint.embed([t or "" for _, t in rows])[0], strict=True)}
    # a band is some samples at fixed places of one class; not one beyond the end of the text
    size, bands = edit_fingerprint.SAMPLES, edit_fingerprint.BANDS
    parts = lambda f: {(int(f[:2], 16) + k, b, x) for k in range(2) for b in range(bands) if (x := f[2 + size * k + size // bands * b :][: edit_fingerprint.BAND]).strip("0")}
    alike = lambda a, b: prints[a] == prints[b] or (parts(prints[a]) & parts(prints[b]) and edit_fingerprint.likeness(prints[a], prints[b]) >= edit_fingerprint.NEAR_LIKE)
    want = components(prints, [(a, b) for a in prints for b in prints if a < b and alike(a, b)])
    assert want[1030] == 1010 and want[1050] == 1020 and want[1045] == 1005 and want[1031] == 1031
    got = edit_fingerprint.near_duplicates(table(spark, rows)).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want and len(got) == len(rows)
    assert {x["doc_id"]: x["class_id"] for x in edit_fingerprint.against_edits(table(spark, rows)).collect()} == want


def test_chunks_of_odd_ids(spark, monkeypatch):
    """Ids at both ends of the range, very uneven ones, one id for many rows and none for many."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 300)
    ids = [-(2**63), 2**63 - 1, 0, *range(10**12, 10**12 + 200), *[7] * 40, *[None] * 120]
    rows = [(i, f"text {k % 90} of some length") for k, i in enumerate(ids)]
    df, plan = chunks.dealt(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    held = {}
    for x in df.collect():
        held.setdefault(x["chunk"], []).append(x.asDict())
    found = []
    for c in sorted(held):
        got = chunks.ordered(pa.Table.from_pylist(held[c]))
        found += list(zip(*got, strict=True))
        assert sum(len(t) for i, t in zip(*got, strict=True) if i != 7) < 2000
    with_id = [x[0] for x in found if x[0] is not None]
    assert with_id == sorted(with_id) and sorted(found, key=str) == sorted(((i, t.encode()) for i, t in rows), key=str)


def test_pages(spark):
    page = '<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A  title &amp; more</h1><p>First\n para &lt;b&gt; of text, with <b>bold</b> words.<p>Second one.<br>Next line.</p><ul><li>An item of the list.</li></ul></article><section class="comments"><div class="comment"><p>Nice, thanks!</p></div></section><aside class="sidebar"><p>Other stories here.</p></aside><footer>&copy; site</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "v", "<nav><a href=x>Menu</a></nav>"), (1, "u", page)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "A title & more\nFirst para <b> of text, with bold words.\nSecond one. Next line.\nAn item of the list."
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] in (2, 3)} == {""}
    assert html_crf.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    field = html_crf.trained_field()
    wrong = total = 0
    for p, main in html_crf.labelled_pages(80, seed=123):
        found = html_crf.blocks(p)
        for b, y in zip(found, field.decode(field.index(html_crf.features(found)))):
            wrong, total = wrong + ((b.text in main) != bool(y)), total + 1
    assert wrong <= 0.01 * total
