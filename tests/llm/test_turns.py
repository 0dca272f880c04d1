"""Repairing conversations: against all ways of editing, one by one, and odd tables."""

import hashlib
import random
import re

import pytest

from stemma.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, digest string, conv int, tag int"
SPACE = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying everything."""
    kind, best = faults(rows), None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for n in range(3):
                for more in [[]] if n == 0 else [["user"], ["assistant"]] if n == 1 else [["user", "assistant"], ["assistant", "user"]]:
                    full = out + [(r, "") for r in more]
                    if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in full)):
                        found = (cost + 3 * n, audit + "I" * n, full)
                        if best is None or found[:2] < best[:2]:
                            best = found
            return
        _, role, text = rows[i]
        for n in range(3):
            for more in [[]] if n == 0 else [["user"], ["assistant"]] if n == 1 else [["user", "assistant"], ["assistant", "user"]]:
                head = out + [(r, "") for r in more]
                if not re.fullmatch(r"s?(ua)*u?", "".join(r[:1] or "?" for r, _ in head)):
                    continue
                go(i + 1, cost + 3 * n + 4, audit + "I" * n + "D", head)
                if kind[i] not in ("blank", "duplicate"):
                    add = 3 * (kind[i] == "truncated")
                    for edit, c, r in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                        after = head + [(r, text)]
                        if re.fullmatch(r"s?(ua)*u?", "".join(x[:1] or "?" for x, _ in after)):
                            go(i + 1, cost + 3 * n + c + add, audit + "I" * n + edit, after)

    go(0, 0, "", [])
    return best


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    kind = faults(rows)
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not a[1] for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = cheapest(rows)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, kind.count("blank"), kind.count("duplicate"), kind.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()), out


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(9)
    out = {}
    for i in range(150):
        rows = []
        for t in range(r.randrange(6)):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "upper"))
            text = r.choice(("Hi.", "Well?", "no end", "", " \n", None, "Done! \t", "é.", "Hi."))
            rows.append((r.choice((t, t, t, 3 * t, None, 2)), role, text))
            if r.random() < 0.2:
                rows.append(rows[-1])
        out[i] = rows
    return out


@pytest.mark.parametrize("segment", [64, 2])
def test_like_all_ways(spark, conversations, segment, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rows = [(i, *x, "clash", 1, 2) for i, v in conversations.items() for x in v]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = spark.createDataFrame([(i,) for i in conversations for _ in range(2)], "conv_id long")
    got = {r[0]: tuple(r[1:]) for r in turns.audit(df, ids=ids).collect()}
    want = {i: expected(v) for i, v in conversations.items()}
    assert got == {i: w[0] for i, w in want.items()}
    back = {}
    for r in turns.repair(df).collect():
        back.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.edit))
    for i, (_, out) in want.items():
        own = sorted(back.get(i, []))
        assert [x[1:3] for x in own] == out and [x[0] for x in own] == list(range(len(out)))


def test_segments_agree(spark, monkeypatch):
    """A long conversation, a row repeated many times and one without an id: the same whether cut or not."""
    r = random.Random(4)
    rows = [(7, t, r.choice(("user", "assistant", "system", "x")), f"text {t}" + r.choice((".", "", "!"))) for t in range(700)]
    rows += [(7, 350, "user", "again.")] * 300 + [(8, None, "user", "same?")] * 500 + [(None, t, "user", f"{t}.") for t in range(40)] + [(9, 5, "assistant", "last." * 100_000)]
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).repartition(5)
    found = []
    for segment in (8, 64, 900):
        monkeypatch.setattr(turns, "SEGMENT", segment)
        found.append(sorted((repr(tuple(x)) for x in turns.audit(df).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turns.audit(empty).count() == turns.repair(empty).count() == turns.damaged(empty).count() == 0
    got = turns.audit(empty, ids=spark.createDataFrame([(1,), (None,)], "conv_id long")).collect()
    assert sorted(repr(tuple(r)[1:]) for r in got) == [repr((0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))] * 2


def test_damage(spark):
    from zlib import crc32

    rows = [(i, t, role, text) for i in (1, 2, None) for t in (*range(60), None) for role, text in (("assistant", "A. b! c?"), (None, None))]
    got = sorted(map(repr, turns.damaged(spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA)).collect()))
    want = []
    for i, t, role, text in rows:
        kind = crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(i, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert len(got) == len(want)
    assert got == sorted(f"Row(conv_id={i!r}, turn={t!r}, role={r!r}, text={x!r})" for i, t, r, x in want)
