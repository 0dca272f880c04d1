"""Periodic runs against all periods tried at all places, and odd tables."""

import hashlib
import random
from zlib import crc32

import numpy as np

from stemma.llm import periodic

SCHEMA = "doc_id long, text string, start string, period long, runs int"


def brute(words, shortest=12):
    """Maximal stretches with word k = word k + p, less those that have a smaller period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k < n - p:
            e = k
            while e < n - p and words[e] == words[e + p]:
                e += 1
            if e - k >= p and e - k + p >= shortest:
                best.setdefault((k, e + p - k), p)
            k = e + 1
    return sorted((s, n_, p) for (s, n_), p in best.items())


def keep(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def documents():
    r = random.Random(11)
    out = [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 500, [b"a", b"b"] * 6, [b"a", b"b"] * 300 + [b"a"], [b"a", b"a", b"b"] * 90]
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    out.append(fib[1])
    for _ in range(120):
        letters = [f"w{k}".encode() for k in range(r.choice((1, 2, 2, 3, 5, 40)))]
        words = []
        while len(words) < r.randint(0, 160):
            part = [r.choice(letters) for _ in range(r.randint(1, 20))]
            words += part * r.choice((1, 1, 2, 3, 5))
        out.append(words[: r.randint(1, 200)])
    return out


def test_like_brute_force():
    docs = documents()
    for got, words in zip(periodic.find(docs), docs, strict=True):
        want = brute(words)
        assert [tuple(x) for x in got.tolist()] == want
        assert periodic.collapsed(words, got).split() == keep(words, want)


def test_other_limits(monkeypatch):
    docs = documents()
    monkeypatch.setattr(periodic, "GRID", 50)
    for shortest in (2, 5, 30):
        for got, words in zip(periodic.find(docs[:60], shortest), docs, strict=False):
            assert [tuple(x) for x in got.tolist()] == brute(words, shortest)


def test_rows(spark):
    docs = documents()
    r = random.Random(2)
    rows = [(k, b"".join(w + r.choice((b" ", b"\n", b" \t ")) for w in words).decode()) for k, words in enumerate(docs)]
    rows += [(1000, None), (1000, ""), (None, "x " * 40), (None, None), (3, "y " * 20), (1004, "  "), (1001, "one two three " * 20_000), (1002, "a" * 300_000), (1003, "é ü " * 9 + chr(0x3000) + " a" + chr(0xA0) + "b")]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    plain, changed = periodic.detect(df).collect(), periodic.detect(df, digests=True, change=periodic.planted).collect()
    assert len(plain) == len(changed) == len(rows)
    texts = {i: (t or "").encode().split() for i, t in rows if i not in (None, 1000, 3)}
    for row in plain:
        if row.doc_id in texts:
            words = texts[row.doc_id]
            runs = [(0, 60_000, 3)] if row.doc_id == 1001 else brute(words)
            assert [tuple(x) for x in row.runs] == runs and row.n_runs == len(runs)
            assert row.collapsed.encode() == b" ".join(keep(words, runs))
            s, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, p, 1000 * n // p if runs else None)
    for row in changed:
        if row.doc_id in texts and row.doc_id != 1001:
            words = texts[row.doc_id]
            h = crc32(str(row.doc_id).encode())
            if h % 10 == 0 and words:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            runs = brute(words)
            assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            assert row.collapsed_sha256 == hashlib.sha256(b" ".join(keep(words, runs))).hexdigest()
    assert sum(row.doc_id is None for row in plain) == 2
    assert sorted(row.n_runs for row in plain if row.doc_id is None) == [0, 1]


def test_no_rows(spark):
    assert periodic.detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extensions():
    r = np.random.default_rng(4)
    symbols = np.concatenate((r.integers(0, 2, 70), np.full(40, 3))).astype(np.int32)
    ends = np.repeat([70, 110], [70, 40])
    own = periodic.Extensions(symbols, ends, 70)
    for i, j in ((x, y) for lo, hi in ((0, 70), (70, 110)) for x in range(lo, hi) for y in range(lo, hi) if x != y):
        k = 0
        while max(i, j) + k < ends[i] and symbols[i + k] == symbols[j + k]:
            k += 1
        assert own.of(np.array([i]), np.array([j]))[0] == k
