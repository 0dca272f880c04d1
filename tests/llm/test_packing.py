"""Packing: the ids against the tokenizers library, the layout against a bin-by-bin best-two-fit, and odd tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stemma.llm import packing
from stemma.llm.byte_bpe import ByteEncoder
from stemma.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, block long, rank int"
ODD = ["", " ", "\n", "a ", " a", "a\n b", "a \nb", "a  b", "a\n\n\nb \n\n", "don't 's x'll", "x <|endoftext|>y", "a  <|endoftext|> b", "a" * 500 + " b", "a\tb\r\n c", "1½ x² 2-3", "".join(map(chr, (0x65E5, 0x672C, 32, 0x1F600))),
       *("a" + chr(c) + end for c in (0x1C, 0x85, 0xA0, 0x200B, 0x3000, 0x301) for end in (" b", "  b", "\n b", " ", ""))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5, 6) for i, t in rows], SCHEMA).repartition(3)


def test_ids_like_the_library():
    own = ByteEncoder(PATH)
    r = random.Random(3)
    words = ["word", "the", "Émile", "x1", "...", "it's", "naïve,", "ab" * 60]
    texts = [*ODD, *("".join(r.choice(words) + r.choice((" ", " ", "\n", "  ", " \n", "")) for _ in range(r.randrange(60))) for _ in range(300))]
    for batch in (texts, texts[::-1], [""], texts[:1]):
        for t, ids in zip(batch, own.encode(batch), strict=True):
            assert ids.tolist() == own.model.encode(t, add_special_tokens=False).ids, t
    own.forget()
    assert [x.tolist() for x in own.encode(texts)] == [own.model.encode(t, add_special_tokens=False).ids for t in texts]


def one_by_one(lengths, size):
    """Best-two-fit on single pieces: the number of sequences."""
    left, bins = sorted(lengths), 0
    while left:
        gap, held = size, []
        for x in reversed(left.copy()):
            if x <= gap:
                held.append(x)
                left.remove(x)
                gap -= x
        if gap and len(held) > 1:
            small = held[-1]
            pairs = [(a + b, -i, -j) for i, a in enumerate(left) for j, b in enumerate(left[:i]) if small < a + b <= gap + small]
            if pairs:
                _, i, j = max(pairs)
                a, b = left[-i], left[-j]
                left.remove(a)
                left.remove(b)
                left.append(held.pop())
                left.sort()
        bins += 1
    return bins


def test_layout_like_bin_by_bin():
    r = random.Random(5)
    for _ in range(150):
        size = r.randint(4, 50)
        lengths = [min(size, 1 + int(r.expovariate(4 / size))) if r.random() < 0.7 else r.randint(1, size) for _ in range(r.randrange(120))]
        counts = np.bincount(lengths, minlength=size + 1)
        slots = packing.best_two_fit(counts, size)
        filled, packed = {}, Counter()
        for s in slots:
            packed[s.length] += s.each * s.bins
            for b in range(s.bins):
                filled.setdefault(s.sequence + b, []).append((s.offset, s.each * s.length))
        assert packed == Counter(lengths)
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= size
        assert sorted(filled) == list(range(len(filled)))
        assert abs(len(filled) - one_by_one(lengths, size)) <= 1 + len(filled) // 50  # ties between pairs may fall otherwise
        assert len(filled) >= -(-sum(lengths) // size)


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces(spark, size):
    r = random.Random(7)
    texts = [*ODD, None, *(" ".join(r.choice(("alpha", "beta", "of", "it")) for _ in range(r.choice((3, 3, 20, 60)))) for _ in range(150))]
    texts += ["one two three"] * 200 + ["word " * 9000]
    rows = [*((i, t) for i, t in enumerate(texts)), (0, texts[0]), (None, "no id"), (None, "no id"), (5, "again")]
    got = packing.pack(table(spark, rows), PATH, size=size, ids=True)
    pieces = got.collect()
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    model = ByteEncoder(PATH).model
    want = Counter()
    for i, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cut_up(len(ids), size)):
            part = ids[start : start + n]
            want[i, k, start, n, zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
            assert n == size or k == 0
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32, tuple(p.ids)) for p in pieces) == want
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length, p.ids))
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    total = sum(p.length for p in pieces)
    assert len(bins) <= 1.03 * -(-total // size) + 1
    assert {s.sequence_id: s.ids for s in packing.sequences(got).collect()} == {k: [x for part in sorted(v) for x in part[2]] for k, v in bins.items()}
    again = packing.pack(table(spark, rows), PATH, size=size).collect()
    assert sorted((p.doc_id or -1, p.piece, p.length, p.ids_crc32) for p in again) == sorted((p.doc_id or -1, p.piece, p.length, p.ids_crc32) for p in pieces)


def test_no_rows(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0
    assert packing.pack(table(spark, [(1, None), (2, "")]), PATH, end=None).count() == 0
