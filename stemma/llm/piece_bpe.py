"""SentencePiece encoding and decoding of merge-type (BPE) models.

The encoding is found by backtracking rather than by a merge queue. At each place the longest piece
is tried first (Aho-Corasick gives the longest match for every start); a piece is accepted after its
predecessor only if the two are *compatible*: re-merging their joined characters by the model's own
rule (best score first, leftmost on ties) gives exactly these two pieces back. When no piece fits, the
place is marked in a bit field, so that it is never tried again, and the last piece is shortened.

Why that is exact: restricted to two neighbouring pieces, the merges of the whole text happen in the
order in which they happen on those characters alone, as long as no merge crosses their outer
borders. The first merge to cross any border would therefore also happen when the two pieces are
re-merged alone. A sequence all of whose neighbours are compatible is thus the model's own result,
and there is only one of those.

Texts are cut where no piece of the vocabulary can cross (before a word-start mark that follows
something else, and around characters that are in no piece of two or more characters), so results of
frequent words are remembered: `MEMORY` bytes of them at most, none longer than `WORD` characters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, id_text, on_workers, sha256

MARK = "▁"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


#: Bytes of remembered words, about; of either half the one not filled of late is forgotten first.
MEMORY = 40 << 20
#: Pairs of pieces whose compatibility is remembered.
PAIRS = 200_000
#: Characters of a word that is remembered.
WORD = 64


class MergeEncoder:
    """memory: about how many bytes of words and their ids are remembered; beyond it, words not met for the longest time are forgotten."""

    def __init__(self, model_path: str, memory: int = MEMORY):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        probe = " a  bé "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models with identity normalisation and a leading word mark are supported")
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_id = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        if len(self.byte_id) != 256:  # else runs of unknown characters have one id together, across words
            raise ValueError("only models with byte fallback are supported")
        self.raw = [p.replace(MARK, " ").encode() if not special[i] else b"" for i, p in enumerate(self.pieces)]
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.raw[model.unk_id()] = b" \xe2\x81\x87 "
        self.trie = ahocorasick.Automaton()
        for p in self.id:
            self.trie.add_word(p, (len(p) - 1, p))
        self.trie.make_automaton()
        self.decimal = {p: str(i) for p, i in self.id.items()}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in self.id}
        chars = "".join(re.escape(p) for p in sorted(self.id) if len(p) == 1)
        self.spellable, self.runs = re.compile(f"[{chars}]+").fullmatch, re.compile(f"[{chars}]+|[^{chars}]").findall
        joined = {c for p in self.id if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            joined = None  # a piece crosses words: whole texts are encoded at once
        inner = "".join(map(re.escape, sorted((joined or set()) - {MARK})))
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]" if inner else "(?s).+")
        self.fits: dict[str | None, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.apart = bool(inner)
        self.memory, self.ids_of = memory, _Ids(self)

    def remerge(self, text: str) -> list[str]:
        """The model's merges on a short text."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, last: str | None, piece: str) -> bool:
        if self.pairs > PAIRS:
            self.fits.clear()
            self.pairs = 0
        self.pairs += 1
        ok = self.fits[last][piece] = self.remerge((last or "") + piece) == ([piece] if last is None else [last, piece])
        return ok

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text without characters unknown to the model."""
        n = len(text)
        longest: list[str | None] = [None] * (n + 1)
        for end, (k, piece) in self.trie.iter(text):  # by their ends: of those with one start the longest comes last
            longest[end - k] = piece
        failed: bytearray | None = None  # a bit, as a byte, for each place from which no way leads on
        pieces: list[str] = []
        fits, shorter, last, at, piece = self.fits, self.shorter, None, 0, longest[0]
        known = fits[last].get
        while at < n:
            while piece is not None:
                if (ok := known(piece)) is None:
                    ok = self.compatible(last, piece)
                    known = fits[last].get
                if ok and (failed is None or not failed[at + len(piece)]):
                    break
                piece = shorter[piece]
            if piece is not None:
                pieces.append(piece)
                last, known = piece, fits[piece].get
                at += len(piece)
                piece = longest[at]
            else:
                if not pieces:
                    raise ValueError(f"the vocabulary has no encoding of {text!r}")
                failed = failed or bytearray(n + 1)
                failed[at] = 1
                at -= len(last)
                piece = shorter[pieces.pop()]
                last = pieces[-1] if pieces else None
                known = fits[last].get
        return pieces

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part that no merge leaves: runs of characters in the vocabulary by backtracking, others as bytes."""
        if self.spellable(part):
            return [self.id[p] for p in self.backtrack(part)]
        ids: list[int] = []
        for run in self.runs(part):
            if run in self.id or self.spellable(run):
                ids += [self.id[p] for p in self.backtrack(run)]
            else:
                ids += [self.byte_id[b] for b in run.encode("utf-8", "surrogatepass")]
        return ids

    def parts(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        """Bytes of all pieces in turn, without the space that the encoder puts before a text."""
        return "".join(self._decode_parts(ids)).removeprefix(" ")

    def _decode_parts(self, ids: list[int]) -> list[str]:
        return [b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        self.ids_of.make_room()
        words = text.split(" ") if text else []
        if not self.apart or "" in words or MARK in text:  # pieces may hold several marks: parts with their marks, after one more
            words = [MARK + x for x in self.parts(text)]
        ids = ",".join(list(map(self.ids_of.__getitem__, words)))
        changed = self.ids_of.changed
        if words and words[0][:1] != MARK and (not changed or changed.keys().isdisjoint(words)):
            decoded = text  # all words decode to themselves
        else:
            decoded = "".join([changed[w] if w in changed else (" " + w if w[:1] != MARK else w[1:].replace(MARK, " ")) for w in words]).removeprefix(" ")
        return ids.count(",") + 1 if ids else 0, sha256(ids), sha256(decoded)


class _Ids(dict):
    """word -> its ids joined by commas; changed has what they decode to, if that is not the word after a space.

    A word that begins with a mark is a part of a text, as it stands behind that mark.
    """

    def __init__(self, encoder: MergeEncoder):
        super().__init__()
        self.encoder, self.changed, self.size = encoder, {}, 0
        self.before: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.long: list[str] = []

    def make_room(self) -> None:
        """Long words are forgotten at once, others when half the memory is full: then the other half is."""
        for word in self.long:
            self.pop(word, None)
            self.changed.pop(word, None)
        self.long.clear()
        if 2 * self.size > self.encoder.memory:
            self.before = dict(self), dict(self.changed)
            self.clear()
            self.changed.clear()
            self.size = 0

    def __missing__(self, word: str) -> str:
        own = self.encoder
        found = self.before[0].get(word)
        if found is None:
            whole = word[1:] if word[:1] == MARK else MARK + word
            if len(whole) <= WORD and own.spellable(whole):  # pieces of the vocabulary, which decode to what they spell
                found = ",".join([own.decimal[p] for p in own.backtrack(whole)])
            else:
                ids = [i for part in own.cut.findall(whole) for i in own.encode_part(part)]
                text, found = "".join(own._decode_parts(ids)), ",".join(map(str, ids))
                if text != whole.replace(MARK, " "):
                    self.changed[word] = text
        elif word in self.before[1]:
            self.changed[word] = self.before[1][word]
        if len(word) > WORD:
            self.long.append(word)
        else:
            self.size += 4 * len(word) + len(found) + 260  # about what the objects and their places in the table take
        self[word] = found
        return found


@lru_cache(maxsize=2)
def encoder(model_path: str) -> MergeEncoder:
    """One for each Python worker."""
    return MergeEncoder(model_path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, then ids and decoded, or with digests ids_sha256 and decoded_sha256; one row per row of df.

    Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated rows; a
    null id stays null. An empty table gives none. Of df's columns only the two named ones are read.
    No shuffle: each row is encoded where it is read.
    """
    schema = DIGESTS if digests else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for b in batches:
            ids = b.column(0)
            texts = b.column(1)
            if digests:
                rows = [own.digest(t.as_py()) for t in texts]
                yield batch(schema, ids, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
            else:
                coded = [own.encode(t.as_py()) for t in texts]
                yield batch(schema, ids, [len(x) for x in coded], coded, [own.decode(x) for x in coded])

    on_workers(df.sparkSession)
    columns = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return id_text(df, id_col, text_col).mapInArrow(run, columns)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded of arrays of ids; a null array decodes to an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for b in batches:
            yield batch(schema, b.column(0), [own.decode(x or []) for x in b.column(1).to_pylist()])

    on_workers(df.sparkSession)
    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, decoded string")
