"""Ids of byte-level BPE, as the tokenizers library gives them.

The library is slow on words, and words repeat. No token of these models' pattern reaches from a word
(a run without white space) into the white space after it, and of the white space before it only one
space. So the ids of a text are those of its words, each with its space, and of what white space is
left between them. Words of many texts are hashed at once in numpy and looked up in a table of what
they became before; the new ones are encoded together. Where the vocabulary is numbered in the order of
its merges, tiktoken merges them, which is faster and gives the same ids. Words that are long, or of
letters whose class may differ between versions of Unicode, and texts with special tokens or rare
kinds of white space are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .common import pieces
from .words import mix, word_hashes

#: The split that byte-level models without a pattern of their own use. (A fixed value.)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and ids that are remembered.
WORDS, IDS = 3 << 19, 6 << 20
#: Bytes of a word that tiktoken merges, whose time grows with the square of it.
LONG = 100
#: Letters beyond this code point are left to the tokenizers library.
PLAIN = chr(0x24F)
#: Characters of texts that are encoded at once.
RUN = 4 << 20

#: White space to the pattern or to Python beyond the six ASCII characters.
_RARE_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]").search
_SPACED, _CHECK = np.uint64(0xD1B54A32D192ED03), 0x8CB92BA72F3D8DD7


class ByteEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        split = spec.get("pre_tokenizer") or {}
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.merged = self._by_rank(spec) if self.by_words else None
        self.line = self.whole("\n")
        self.space: dict[bytes, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.check, self.at, self.size = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.pool = np.zeros(0, np.uint32)

    def _by_rank(self, spec: dict):
        """tiktoken's encoding, if ids are in the order of the merges; else None."""
        import tiktoken

        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        if spec["model"].get("type") != "BPE" or any(vocab[m.replace(" ", "", 1)] != 256 + i for i, m in enumerate(merges)):
            return None
        # bytes that are no visible Latin-1 characters are written as characters from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for run in pieces(texts, RUN):
            plain = [self.by_words and not self.special(t) and not _RARE_SPACE(t) for t in run]
            known = self._run([t.encode() for t, p in zip(run, plain, strict=True) if p])
            for t, p in zip(run, plain, strict=True):
                yield next(known) if p else self.whole(t)

    def _run(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        key, count = word_hashes(texts)
        check, _ = word_hashes(texts, _CHECK)
        blob = b" ".join(texts)
        x = np.frombuffer(blob + b" ", np.uint8)
        inside = np.concatenate(([False], ~((x == 32) | (x - 9 < 5)), [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        first, last = np.cumsum(count) - count, np.cumsum(count)
        # the white space before each word, less the one space that goes with it, and what is left behind the last one
        before = np.concatenate(([0], end[:-1])) if len(end) else end
        before[first[count > 0]] = begin[count > 0]
        spaced = (start > before) & (x[start - 1] == 32)
        left = np.flatnonzero(start - before > spaced)
        tail = np.where(count > 0, end[last - 1] if len(end) else 0, begin)
        gaps = [self._gap(blob[a:b], s) for a, b, s in zip(before[left].tolist(), (start - spaced)[left].tolist(), spaced[left].tolist(), strict=True)]
        behind = np.flatnonzero(begin + size > tail)
        gaps += [self._gap(blob[a:b], True) for a, b in zip(tail[behind].tolist(), (begin + size)[behind].tolist(), strict=True)]

        key = np.where(spaced, mix(key ^ _SPACED), key)
        unit, at, back = np.unique(key, return_index=True, return_inverse=True)
        if len(at) and (check[at][back] != check).any():  # two words of one hash of 64 bits
            yield from (self.whole(t.decode()) for t in texts)
            return
        from_, many = self._units(unit, check[at], [blob[a:b] for a, b in zip((start - spaced)[at].tolist(), end[at].tolist(), strict=True)])
        # words and gaps in their order: a gap stands before its word, or before the first word of the next text
        place = np.concatenate((np.arange(len(start)) * 2 + 1, left * 2, last[behind] * 2 - 1))
        order = np.argsort(place, kind="stable")
        pool = np.concatenate([self.pool, *gaps]) if gaps else self.pool
        sizes = np.array([len(g) for g in gaps], np.int64)
        from_ = np.concatenate((from_[back], len(self.pool) + np.cumsum(sizes) - sizes))[order]
        many = np.concatenate((many[back], sizes))[order]
        whose = np.concatenate((np.repeat(np.arange(len(texts)), count), np.repeat(np.arange(len(texts)), count)[left], behind))[order]
        order = np.argsort(whose, kind="stable")  # texts without a word, too
        from_, many, whose = from_[order], many[order], whose[order]
        ends = np.cumsum(many)
        ids = pool[np.repeat(from_ - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.concatenate(([0], ends))[np.searchsorted(whose, np.arange(len(texts) + 1))]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            yield ids[a:b]

    def _gap(self, space: bytes, alone: bool) -> np.ndarray:
        """Ids of white space; unless alone, its last character stands apart, as a word follows."""
        if space not in self.space or len(self.space) > 10_000:
            self.space = {space: self.whole(space.decode())} if len(self.space) > 10_000 else self.space | {space: self.whole(space.decode())}
        if alone or len(space) == 1:
            return self.space[space]
        return np.concatenate((self.whole(space[:-1].decode()), self.whole(space[-1:].decode())))

    def _units(self, unit: np.ndarray, check: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each of these distinct words begin, and how many they are."""
        if len(self.keys) + len(unit) > WORDS or len(self.pool) > IDS:
            self.forget()
        at = np.searchsorted(self.keys, unit)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        hit = (self.keys[near] == unit) & (self.check[near] == check) if len(self.keys) else np.zeros(len(unit), bool)
        from_, many = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        from_[hit], many[hit] = self.at[near[hit]], self.size[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            coded = self._new([words[i] for i in new.tolist()])
            many[new] = [len(c) for c in coded]
            from_[new] = len(self.pool) + np.cumsum(many[new]) - many[new]
            self.pool = np.concatenate((self.pool, *coded))
            keys = np.concatenate((self.keys, unit[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.check = keys[order], np.concatenate((self.check, check[new]))[order]
            self.at, self.size = np.concatenate((self.at, from_[new]))[order], np.concatenate((self.size, many[new]))[order]
        return from_, many

    def _new(self, words: list[bytes]) -> list[np.ndarray]:
        text = [w.decode() for w in words]
        out: list = [None] * len(text)
        plain = [i for i, w in enumerate(text) if self.merged is not None and len(w) <= LONG and max(w) <= PLAIN]
        if plain:
            # a line end before each word is a token of its own, and words hold none
            ids = np.array(self.merged("\n" + "\n".join([text[i] for i in plain])), np.uint32)
            for i, own in zip(plain, np.split(ids, np.flatnonzero(ids == self.line[0]))[1:], strict=True):
                out[i] = own[1:]
        return [self.whole(text[i]) if own is None else own for i, own in enumerate(out)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(path)
