"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

Base findings are the matches of three fixed patterns. Further candidates are all runs of 16 or more
key characters, whatever they hold, unless a base finding covers all of a run. Every finding and
candidate is scored by a small convolutional network over the characters of the whole candidate and
`CONTEXT` characters on either side: two filter widths over one-hot character classes (once for
context, once for the candidate itself), ReLU, maximum and mean over all places, one linear layer. It
is trained in numpy on labelled findings that `labelled_findings` writes by rule (a bounded, documented
number; the tables have no labels for secrets), its scores are calibrated on held-out findings
(Platt), and the threshold is the highest one that keeps `RECALL` of the held-out secrets. Candidates at
or above it are added as kind `net`; base findings stay whatever their score.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, on_workers, sha256

# The base patterns; kinds in this order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "net")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
CONTEXT = 24
#: Share of held-out secrets that the threshold keeps.
RECALL = 0.98
#: Labelled findings the network is trained on; as many again divided by three are held out.
FINDINGS = 3600
SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])

_CLASSES = 41
_TABLE = np.full(0x250, 40, np.uint8)
for _i, _c in enumerate("0123456789"):
    _TABLE[ord(_c)] = 1 + _i
for _i in range(26):
    _TABLE[ord("a") + _i] = 11 + min(_i, 6)  # a-f apart: hex
    _TABLE[ord("A") + _i] = 18 + min(_i, 6)
for _i, _c in enumerate(" \n\"'=:/+_-.,@;<>"):
    _TABLE[ord(_c)] = 24 + min(_i, 15)


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of key characters that no base finding covers."""
    out, end, at = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] <= a:
            end, at = max(end, base[at][1]), at + 1
        if end < b:
            out.append((a, b))
    return out


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def labelled_findings(n: int, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """n (text, start, end, secret or not) by rule, half of them secrets.

    Secrets are drawn from alphabets, some behind a prefix or in parts. What is harmless is what people
    write without spaces: long words, hosts, paths, file names, identifiers, dates, numbers, lines of marks.
    """
    r = random.Random(seed)
    some = lambda chars, a, b=None: "".join(r.choice(chars) for _ in range(r.randint(a, b or a)))
    mixed, code = _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/"
    onsets, vowels, codas = "b c d f g h j k l m n p r s t v w z br ch cl dr fl gr pl pr sch sh sp st th tr qu".split(), "a e i o u ai au ea ei ie io oo ou".split(), "n r s t l m d ng nd st ck th lt ns tion ment".split() + [""] * 14
    syllable = lambda: r.choice([*onsets, "", ""]) + r.choice(vowels) + r.choice(codas)
    word = lambda a=1, b=4: "".join(syllable() for _ in range(r.randint(a, b)))
    name = lambda: r.choice((str.lower, str.capitalize, str.lower, str.upper))(word(1, 3)) + r.choice(("", "", "", some(_DIGITS, 1, 4)))
    prose = lambda k: " ".join(word() + r.choice(("", "", "", ",", ".")) for _ in range(k))
    joined = lambda by, a, b: by.join(name() for _ in range(r.randint(a, b)))
    part = lambda: some(r.choice((mixed, mixed, _LOWER + _DIGITS, _UPPER + _DIGITS, code)), 16, 44)
    secrets = (
        lambda: some(mixed, 16, 64), lambda: some(code, 24, 88) + r.choice(("", "=", "==")), lambda: some(_LOWER + _DIGITS, 18, 48), lambda: some(_UPPER + _DIGITS, 18, 40), lambda: some("0123456789abcdef", 18, 23) + some("0123456789", 0, 1),
        lambda: some(_LOWER, 2, 5) + r.choice("_-") + part(), lambda: some(_LOWER, 2, 4) + r.choice("_-") + r.choice(("live", "test", "prod", "app")) + r.choice("_-") + part(), lambda: some(_UPPER, 2, 4) + r.choice(("", "_", "-")) + part(),
        lambda: "eyJ" + some(mixed, 14, 40) + "." + some(mixed + "_-", 20, 60) + r.choice(("", "." + some(mixed + "_-", 20, 43))), lambda: some(_DIGITS, 9, 13) + r.choice("-:") + part(), lambda: "AKIA" + some(_UPPER + _DIGITS, 16), lambda: part() + r.choice("/.-_") + part(),
    )
    marks = lambda: r.choice(("=", "-", "_", ".", "/", "x", "0", "-=", "a", "+")) * r.randint(16, 60)
    harmless = (
        lambda: word(5, 12), lambda: word(6, 9).capitalize(), lambda: joined("", 3, 6), lambda: joined("-", 3, 7), lambda: joined("_", 3, 6), lambda: joined(".", 3, 6), lambda: joined("/", 3, 7), lambda: joined(r.choice("-_"), 2, 4) + "." + r.choice(("html", "txt", "py", "jpeg", "tar.gz", "min.js")),
        lambda: "/".join((joined(".", 2, 3).lower(), *(name() for _ in range(r.randint(1, 4))))), lambda: f"{word(1, 2)}{r.randint(0, 99)}.{word(2, 3)}.{r.choice(('com', 'org', 'net', 'de', 'io', 'co.uk'))}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}Z",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(r.randint(5, 9))), lambda: some(_DIGITS, 16, 24), lambda: "-".join(some(_DIGITS, 2, 6) for _ in range(4)), lambda: "-".join((some("0123456789abcdef", 8), *(some("0123456789abcdef", 4) for _ in range(3)), some("0123456789abcdef", 12))),
        marks, lambda: word(1, 3) + marks(), lambda: marks() + word(1, 2) + str(r.randint(1, 99)), lambda: (_LOWER + _DIGITS)[: r.randint(16, 36)], lambda: _DIGITS * 2 + _LOWER[: r.randint(0, 9)], lambda: joined("", 2, 3) + "." + joined("", 2, 3) + "." + word(1, 2), lambda: (word(1, 2) + "-") * 5 + "end",
    )
    before = ("", "", "", "key: ", "AUTH=", 'bearer "', "export X=", "credential ", "Authorization: ", "pw ", "use ", "(")
    out = []
    for i in range(n):
        yes = i % 2 == 0
        value = r.choice(secrets if yes else harmless)()
        while len(value) < 16:
            value = r.choice(secrets if yes else harmless)()
        lead = prose(r.randint(0, 6)) + " " + r.choice(before if yes or r.random() < 0.3 else ("", "", "see ", "<", "(", '"', f"{word()}@", "\n"))
        text = lead + value + r.choice((" ", ". ", '" ', "\n", ")", ", ", "é ")) + prose(r.randint(0, 6))
        out.append((text, len(lead), len(lead) + len(value), int(yes)))
    return out


class Network:
    """Filters of WIDTHS characters, FILTERS of each; symbol classes inside a candidate are apart from those around it.

    The linear layer sees the largest value of each filter over all places, after ReLU, and its mean, tanh'd.
    """

    WIDTHS, FILTERS = (3, 6), 12

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 0.3, (k, 2 * _CLASSES, self.FILTERS)) for k in self.WIDTHS]
        self.b = [np.zeros(self.FILTERS) for _ in self.WIDTHS]
        self.out, self.bias = r.normal(0, 0.3, 4 * self.FILTERS), 0.0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def symbols(classes: np.ndarray, start: int, end: int) -> np.ndarray:
        """The candidate whole, whatever its length, with its context; padded so that every filter fits."""
        a, b = max(0, start - CONTEXT), min(len(classes), end + CONTEXT)
        x = classes[a:b].astype(np.int64)
        x[start - a : end - a] += _CLASSES
        return np.pad(x, (0, max(0, 6 - len(x))))

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Maxima, then tanh of means, of each width's filters; the places of the maxima; tanh of the values at all places."""
        largest, means, places, all_ = [], [], [], []
        for w, b in zip(self.w, self.b, strict=True):
            k = len(w)
            z = sum(w[j][x[j : len(x) - k + 1 + j]] for j in range(k)) + b
            at, t = z.argmax(0), np.tanh(z)
            places.append(at)
            all_.append(t)
            largest.append(z[at, np.arange(self.FILTERS)])
            means.append(t.mean(0))
        return np.concatenate(largest + means), places, all_

    def logit(self, x: np.ndarray) -> float:
        v = self.features(x)[0]
        half = len(v) // 2
        return float(np.maximum(v[:half], 0) @ self.out[:half] + v[half:] @ self.out[half:] + self.bias)

    def score(self, x: np.ndarray) -> float:
        """Calibrated probability of a secret."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -50, 50))))

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int = 6, rate: float = 0.05, seed: int = 3) -> None:
        """Stochastic gradient descent; through the maximum, only the place that made it learns."""
        r = np.random.default_rng(seed)
        filters, half = np.arange(self.FILTERS), 2 * self.FILTERS
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for i in r.permutation(len(rows)):
                x, y = rows[i]
                v, places, all_ = self.features(x)
                h = np.concatenate((np.maximum(v[:half], 0), v[half:]))
                d = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -50, 50))) - y
                back = d * self.out * np.concatenate((v[:half] > 0, np.ones(half, bool)))
                self.out -= step * (d * h + 1e-4 * self.out)
                self.bias -= step * d
                for n, (at, t) in enumerate(zip(places, all_, strict=True)):
                    g = back[n * self.FILTERS : (n + 1) * self.FILTERS]
                    spread = back[half + n * self.FILTERS : half + (n + 1) * self.FILTERS] * (1 - t * t) / len(t)
                    for j in range(len(self.w[n])):
                        self.w[n][j][x[at + j], filters] -= step * g
                        np.subtract.at(self.w[n][j], x[j : len(x) - len(self.w[n]) + 1 + j], step * spread)
                    self.b[n] -= step * (g + spread.sum(0))

    def calibrate(self, rows: list[tuple[np.ndarray, int]], recall: float = RECALL) -> None:
        """Platt scaling on rows not trained on, by Newton's method, then the highest threshold with that recall on them."""
        z, y = np.array([self.logit(x) for x, _ in rows]), np.array([y for _, y in rows], float)
        # targets a little within 0 and 1, so that the fit is finite even if the rows are told apart
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        both, p = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(both @ p, -50, 50)))
            move = np.linalg.solve((both * (q * (1 - q))[:, None]).T @ both + 1e-9 * np.eye(2), both.T @ (q - t))
            p -= np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-9:
                break
        self.slope, self.shift = map(float, p)
        scores = np.sort([self.score(x) for x, yes in rows if yes])
        self.threshold = float(scores[int(np.floor((1 - recall) * len(scores)))])


@lru_cache(maxsize=1)
def trained_network() -> Network:
    rows = [(Network.symbols(_classes(t), a, b), y) for t, a, b, y in labelled_findings(FINDINGS + FINDINGS // 3)]
    net = Network()
    net.fit(rows[:FINDINGS])
    net.calibrate(rows[FINDINGS:])
    return net


def find(text: str, net: Network) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all findings of a text, by start, then kind."""
    base = base_spans(text)
    more = candidates(text, base)
    if not base and not more:
        return []
    found, first = [], CONTEXT
    for a, b, kind in base + [(a, b, "net") for a, b in more]:
        lo = max(0, a - first)
        score = net.score(Network.symbols(_classes(text[lo : b + CONTEXT]), a - lo, b - lo))
        if kind != "net" or score >= net.threshold:
            found.append((a, b, kind, score))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, as arrays in order of place, kind, start, end (code points, end exclusive) and score; one row per row.

    Null and empty texts have no findings; repeated rows and null ids give a row each; of df's columns
    only the two named ones are read. Whole texts are scanned where they are read, without a shuffle.
    """
    net = trained_network()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py(), net) for t in b.column(1)]
            yield batch(SCHEMA, b.column(0), [[x[2] for x in f] for f in found], [[x[0] for x in f] for f in found], [[x[1] for x in f] for f in found], [[x[3] for x in f] for f in found])

    on_workers(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, kind array<string>, start array<long>, end array<long>, score array<double>")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[secret]") -> DataFrame:
    """df with every finding's characters replaced by mark (overlapping findings by one), and length_col brought up to date.

    All other columns stay as they are; null texts stay null; a text without findings is left alone.
    """
    net, names = trained_network(), df.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for a, b, _, _ in find(text, net):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, new = list(b.columns), [clean(t.as_py()) for t in b.column(at)]
            columns[at] = pa.array(new, b.schema.field(at).type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in new], b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    on_workers(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() as counts of the base kinds, the base findings' sha256 and all findings as kind:start:end."""
    spans = F.transform(F.arrays_zip("kind", "start", "end"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    of = lambda kind: F.size(F.filter("kind", lambda k: k == kind)).cast("long")
    return scan(df, id_col, text_col).select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(F.array_join(F.filter(spans, lambda s: ~s.startswith("net:")), ","), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
        F.size(F.filter("kind", lambda k: k == "net")).cast("long").alias("n_net"),
    )
