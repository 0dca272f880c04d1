"""Repairing the structure of conversations by signature deduplication.

What there is to decide about a conversation follows from its roles and faults alone. These are written
as a signature, a letter for each row; each distinct signature is solved once, by memoised recursion
over its suffixes; the edits are joined back and replayed on the rows.

A long conversation is cut into segments of `SEGMENT` rows with a signature each. A segment's solution
has the cheapest edits from each state before it to each state behind it, so the segments of a
conversation are put together afterwards, at a byte for each row. Texts are left out of all this: a
row is its digest until the edits are replayed. Rows alike are counted where they are read, and what is
sorted is dealt by ranges of conversation, turn and digest, so no conversation is too long for it.

Replaying streams the rows of each conversation, in order and not held, as a digest of all of a
conversation's text can be made in no other way.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_anew, on_workers

#: Rows of a segment.
SEGMENT = 64
#: Costs of edits, and of each truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, behind system, user and assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}

#: What a role's initial leads to in each state where it may stand.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}

#: A segment: its place, its signature (or a number of rows that must go), faults, turns and first and last initials.
_SEGMENT = "no_conv boolean, conv long, part int, seq long, sig string, gone long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, initials string"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "initials"]
_KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in ddl.split(", "))])


@lru_cache(maxsize=50_000)
def _solved(sig: str, state: int) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, edits) from state to each state behind the rows of sig, ties by the least edits.

    s, u, a and o (another role) are rows, capital ones truncated; x is a row that must go.
    """
    if not sig:
        return {state: (0, "")}
    row, rest = sig[0], sig[1:]
    best: dict[int, tuple[int, str]] = {}
    for n in range(3):  # rows put in before this one
        steps = [(DELETE, "D", state)]
        if row != "x":
            more = TRUNCATED * row.isupper()
            steps.append((REROLE + more, "R", _DUE[state]))
            if state in _NEXT.get(row.lower(), ()):
                steps.append((more, "K", _NEXT[row.lower()][state]))
        for cost, edit, then in steps:
            for end, (c, edits) in _solved(rest, then).items():
                found = (n * INSERT + cost + c, "I" * n + edit + edits)
                if end not in best or found < best[end]:
                    best[end] = found
        state = _DUE[state]
    return best


def _packed(sig: str) -> str:
    """All of a signature's solutions as text."""
    return ",".join(f"{a}{b}{edits}:{cost}" for a in range(4) for b, (cost, edits) in _solved(sig, a).items())


class Audit:
    """The edits of a conversation, put together segment by segment.

    Edits that lead to one state at one cost are never the beginning of each other, so of those only the
    least are needed. What the edits to all states begin with is settled and not copied any more.
    """

    def __init__(self):
        self.settled: list[str] = []
        self.open: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, packed: str) -> None:
        now: dict[int, tuple[int, str]] = {}
        for x in packed.split(","):
            edits, _, cost = x[2:].partition(":")
            a, b = int(x[0]), int(x[1])
            if a in self.open:
                found = (self.open[a][0] + int(cost), self.open[a][1] + edits)
                if b not in now or found < now[b]:
                    now[b] = found
        self._settle(now)

    def add_gone(self, n: int) -> None:
        self._settle({k: (cost + n * DELETE, edits + "D" * n) for k, (cost, edits) in self.open.items()})

    def _settle(self, now: dict[int, tuple[int, str]]) -> None:
        same = os.path.commonprefix([edits for _, edits in now.values()])
        self.settled.append(same)
        self.open = {k: (cost, edits[len(same) :]) for k, (cost, edits) in now.items()}

    def end(self) -> tuple[int, str]:
        last = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        cost, edits = min((cost + last[k] * INSERT, edits + "I" * last[k]) for k, (cost, edits) in self.open.items())
        return cost, "".join(self.settled) + edits


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and turn to segments of rows that follow each other."""
    part, schema = TaskContext.get().partitionId(), _schema(_SEGMENT)
    done: list[tuple] = []
    key, seq, sig, counts, initials = None, 0, "", [0] * 4, ""
    low = high = None
    turns = 0

    def finish(gone: int = 0) -> None:
        nonlocal sig, counts, initials, low, high, turns, seq
        if key is not None and (sig or gone):
            done.append((*key, part, seq, sig, gone, *counts, low, high, turns, initials[:1] + initials[-1:]))
            seq += 1
        sig, counts, initials, low, high, turns = "", [0] * 4, "", None, None, 0

    for b in batches:
        for no_conv, conv, turn, initial, blank, cut, copies, first in zip(*(b.column(c).to_pylist() for c in ("no_conv", "conv", "turn", "initial", "blank", "cut", "copies", "first")), strict=True):
            if (no_conv, conv) != key:
                finish()
                key = (no_conv, conv)
            alone = first and not blank
            for n, one in ((1, True), (copies - 1, False)) if alone else ((copies, False),):
                if not n:
                    continue
                if n > SEGMENT:
                    finish()
                counts[0] += n * blank
                counts[1] += n * (not blank and not one)
                counts[2] += one and cut
                counts[3] += n - 1 + bool(initials) - (initials[-1:] + initial in LEGAL)
                initials += initial
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
                if n > SEGMENT:
                    finish(n)
                    continue
                sig += (initial.upper() if cut else initial) if one else "x" * n
                if len(sig) >= SEGMENT:
                    finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done = []
    finish()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(solved=[_packed(s) for s in b["sig"]])


def _keyed(conv: Column) -> list[Column]:
    return [conv.isNull().alias("no_conv"), F.coalesce(conv.cast("long"), F.lit(0)).alias("conv")]


class _Replay:
    """One conversation: its segments first, then its rows in order, then what follows from them."""

    def __init__(self):
        self.audit, self.counts, self.last = Audit(), dict.fromkeys(_COUNTS[:4], 0), ""
        self.low = self.high = None
        self.turns = 0
        self.edits: str | None = None
        self.at, self.state, self.place = 0, START, 0
        self.cost = 0
        self.hash = hashlib.sha256()

    def segment(self, r: dict) -> None:
        if r["solved"] is None and not r["gone"]:
            return  # says only that there is such a conversation
        for k in self.counts:
            self.counts[k] += r[k]
        first, last = r["initials"][:1], r["initials"][-1:]
        self.counts["illegal"] += bool(self.last) and self.last + first not in LEGAL
        self.last = last
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        if r["gone"]:
            self.audit.add_gone(r["gone"])
        else:
            self.audit.add(r["solved"])

    def ready(self) -> None:
        if self.edits is None:
            self.cost, self.edits = self.audit.end()

    def _put(self, role: str, text: str, edit: str, turn: int | None) -> tuple:
        self.hash.update(("\n" * (self.place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.place += 1
        return (self.place - 1, turn, role, text, edit)

    def inserted(self) -> Iterator[tuple]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _DUE[self.state]
            yield self._put(_NAME[self.state], "", "I", None)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self.state = _NEXT[role[0]][self.state] if edit == "K" else _DUE[self.state]
            yield self._put(role if edit == "K" else _NAME[self.state], text, edit, turn)

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts.values(), self.cost, self.edits, self.hash.hexdigest())


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "conv_id long, place long, turn long, role string, text string, edit string"


def _replayer(rows_out: bool):
    schema = _schema(_ROWS if rows_out else _SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, own = None, None

        def finish() -> None:
            if own is not None:
                own.ready()
                conv = None if key[0] else key[1]
                done.extend((conv, *x) for x in own.inserted() if rows_out)
                if not rows_out:
                    done.append((conv, *own.summary()))

        def ready() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done.clear()

        for b in batches:
            for r in b.to_pylist():
                if (r["no_conv"], r["conv"]) != key:
                    finish()
                    key, own = (r["no_conv"], r["conv"]), _Replay()
                if r["tag"] == 0:
                    own.segment(r)
                else:
                    own.ready()
                    made = own.row(r["turn"], r["role"], r["text"])
                    done.extend((None if key[0] else key[1], *x) for x in made if rows_out)
            yield from ready()
        finish()
        yield from ready()

    return run


def _joined(df: DataFrame, ids: DataFrame | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Solved segments (tag 0) and rows (tag 1), each conversation's in order in one partition."""
    on_workers(df.sparkSession)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text_col, role_col))
    rows = df.select(*_keyed(F.col(conv_col)), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    small = rows.select("no_conv", "conv", "turn", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"))
    key = ["no_conv", "conv", "digest"]
    # nulls first, as in the order of turns
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"))
    counted = small.groupBy(*key, "turn", "initial", "blank", "cut").agg(F.count("*").alias("copies"))
    seen = small.groupBy(*key).agg(F.min(turn).alias("earliest"))
    faults = join_anew(counted, seen, key).withColumn("first", turn == F.col("earliest")).drop("earliest")
    order = ["no_conv", "conv", "turn", "digest"]
    # written once: signatures are solved for the very segments that they are joined to
    segments = cut(faults.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, _SEGMENT), "segments")
    solved = segments.where("sig <> ''").select("sig").distinct().mapInPandas(_solve, "sig string, solved string")
    parts = join_anew(segments, solved, ["sig"], "left").select("no_conv", "conv", F.lit(0).alias("tag"), "part", "seq", "solved", "gone", *_COUNTS)
    if ids is not None:
        parts = parts.unionByName(ids.select(*_keyed(F.col(conv_col))).distinct().withColumn("tag", F.lit(0)), allowMissingColumns=True)
    both = parts.unionByName(rows.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return both.repartition("no_conv", "conv").sortWithinPartitions("no_conv", "conv", "tag", "part", "seq", "turn", "digest")


def audit(df: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; one row per conversation.

    A conversation's rows come by turn, null ones first; rows of one turn that differ come by the digest
    of role and text. A null role or text is one space. Each row's first fault counts: blank, a role and
    text seen earlier, truncated (its last character but white space is none of . ! ?). The audit has the
    cheapest edits that leave system? (user assistant)+, or nothing: K(eep), R(erole), D(elete), I(nsert);
    of those the least in ASCII. Only initials of roles count, so an empty role, or one of another
    initial, is never kept as it is. Null conversation ids are one conversation. With ids (a table with the
    column conv_col), conversations without a row in df have zeros, no edits and the hash of no text; an
    empty table gives none. Of df's columns only the four named ones are read.
    """
    return _joined(df, ids, conv_col, turn_col, role_col, text_col).mapInArrow(_replayer(False), _SUMMARY)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place, turn, role, text, edit: the rows that audit() leaves, numbered from 0 in each conversation; inserted ones have no turn."""
    return _joined(df, None, conv_col, turn_col, role_col, text_col).mapInArrow(_replayer(True), _ROWS)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults by the checksum of conversation and turn: dropped, emptied, without ends of sentences, repeated, or of the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    role = F.when(kind == 4, "user").otherwise(part(role_col))
    rows = df.where(kind != 0).select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("again"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("again").alias("again")).drop("again")
