"""Toxicity by a classifier chain.

Categories are predicted one after another; the model of each sees the words of the text and the
probabilities of all categories before it. While training, those are out-of-fold predictions, so that a
later model learns from probabilities of the quality it will get. The first link is the label of low
quality, the last one the label of toxicity. Between them are two degrees of abuse, which no label gives:
they are taken from the labelled rows, as toxic rows with `DEGREES` or more different telling words,
words that toxic rows hold far more often than others (more than `TELLING` standard errors). All links are
logistic regressions on the presence of words, hashed into `1 << BITS` features, fitted in numpy.

Fitting is bounded: at most `SAMPLE` labelled rows of either verdict, those of the smallest hash of
their id. Of these all words count, as they do in scoring, which covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, id_text, on_workers, pieces
from .words import word_hashes

DEGREES = {"repeated_abuse": 2, "heavy_abuse": 4}
CHAIN = ("low_quality", *DEGREES, "toxic")
BITS = 18
SAMPLE = 1500
TELLING = 6.0
#: Standard errors at which a feature counts half.
SURE = 3.0
FOLDS = 3
#: Characters whose words are hashed at once.
PIECE = 400_000
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in CHAIN), ("rejected", pa.bool_())])
_NO_LETTER = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_MARKS = re.compile(r"[^\w\s]|[\d_]")


def _letters(text: str) -> bytes:
    """Lower case, with spaces for all but letters."""
    text = text.lower()
    return text.encode("utf-8", "surrogatepass").translate(_NO_LETTER) if text.isascii() else _MARKS.sub(" ", text).encode("utf-8", "surrogatepass").translate(_NO_LETTER)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different features of each text in a row, and how many each has."""
    h, words = word_hashes([_letters(t) for t in texts])
    both = np.unique(np.repeat(np.arange(len(texts), dtype=np.uint64), words) << np.uint64(BITS) | h >> np.uint64(64 - BITS))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.bincount((both >> np.uint64(BITS)).astype(np.int64), minlength=len(texts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values, 0 for empty ones."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], 0)
    return out


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Where f, which gives its value and gradient, is about least: limited-memory BFGS, with steps halved until they lead down."""
    value, g = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, t, r in reversed(moves):
            used.append(r * (s @ d))
            d = d - used[-1] * t
        if moves:
            s, t, r = moves[-1]
            d = d / (r * (t @ t))
        for (s, t, r), a in zip(moves, reversed(used), strict=True):
            d = d + (a - r * (t @ d)) * s
        slope, size = float(g @ d), 1.0
        while (new := f(x + size * d))[0] > value + 1e-4 * size * slope and size > 1e-6:
            size /= 2
        s, t = size * d, new[1] - g
        if new[0] >= value - 1e-9:
            break
        x, (value, g) = x + s, new
        if s @ t > 1e-12:
            moves = [*moves, (s, t, 1 / float(s @ t))][-memory:]
    return x


@dataclass
class Chain:
    """table[feature]: one weight for each link; links[i]: weights of the probabilities before link i, and its bias."""

    table: np.ndarray
    links: list[np.ndarray]
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each link."""
        own, sizes = features(texts)
        sums, out = _sums(self.table[own].astype(float), sizes), np.zeros((len(texts), len(self.links)))
        for i, link in enumerate(self.links):
            out[:, i] = _chance(sums[:, i] + out[:, :i] @ link[:-1] + link[-1])
        return out

    def scored(self, texts: pa.Array) -> np.ndarray:
        """probabilities() of a column, some texts at a time; null counts as empty."""
        return np.concatenate([np.zeros((0, len(self.links))), *map(self.probabilities, pieces((t.as_py() or "" for t in texts), PIECE))])


def never() -> Chain:
    """A chain that rejects nothing."""
    return Chain(np.zeros((1 << BITS, len(CHAIN)), np.float32), [np.array([0.0] * i + [-50.0]) for i in range(len(CHAIN))], 2.0)


class _Rows:
    """Features of labelled rows, by rows and by features."""

    def __init__(self, own: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.names, self.cols = np.unique(own, return_inverse=True)
        by = np.argsort(self.cols, kind="stable")
        self.rows_by_feature = np.repeat(np.arange(len(sizes)), sizes)[by]
        self.counts = np.bincount(self.cols, minlength=len(self.names))

    def errors(self, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """How many standard errors more of the rows in use with y have each feature than its share of them would give."""
        n, m = max(1, int(use.sum())), float(y[use].sum())
        share = _sums(use[self.rows_by_feature].astype(float), self.counts) / n
        hits = _sums((y * use)[self.rows_by_feature], self.counts)
        return (hits - m * share) / np.sqrt(np.maximum(1e-9, m * (1 - m / n) * share * (1 - share)))

    def logistic(self, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 25, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
        """Weights of features and of [dense, 1] on the rows in use.

        A feature counts by how surely it tells the rows apart, so that many words of chance add up to little.
        """
        z = self.errors(y, use) ** 2
        scale = z / (z + SURE**2)
        extra = np.hstack([dense, np.ones((len(y), 1))])
        m, n = max(1, int(use.sum())), len(self.names)

        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            z = _sums((p[:n] * scale)[self.cols], self.sizes) + extra @ p[n:]
            d = np.where(use, _chance(z) - y, 0.0) / m
            gradient = np.concatenate((_sums(d[self.rows_by_feature], self.counts) * scale, extra.T @ d)) + decay * p
            return float((np.where(use, np.logaddexp(0, z) - y * z, 0.0)).sum() / m + decay / 2 * (p @ p)), gradient

        p = _least(loss, np.zeros(n + extra.shape[1]), steps)
        return p[:n] * scale, p[n:]

    def apply(self, w: np.ndarray, v: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return _chance(_sums(w[self.cols], self.sizes) + np.hstack([dense, np.ones((len(dense), 1))]) @ v)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain for rows of docs (doc_id, text) whose toxic in labels (doc_id, quality, toxic) is 0 or 1.

    Labels of toxicity that are null or of another value, and ids without a text, are left out; a row whose
    quality is unknown trains no model of quality. Of several labels of an id the largest counts. Without
    rows of both verdicts, nothing is ever rejected.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"), F.col("quality").cast("int").alias("q")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("q").alias("q"))
    own = own.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id"))
    few = own.where("y = 1").orderBy("h", "doc_id").limit(sample).unionByName(own.where("y = 0").orderBy("h", "doc_id").limit(sample))
    texts = id_text(docs, "doc_id", "text").join(F.broadcast(few.select("doc_id", "y", "q")), "doc_id")  # at most 2 * sample ids

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("q", pa.int32()), ("own", pa.binary())])
        for b in batches:
            yield batch(schema, b.column(0), b.column(2), b.column(3), [features([t.as_py()])[0].astype(np.int32).tobytes() for t in b.column(1)])

    on_workers(docs.sparkSession)
    # at most 2 * sample ids; of an id with several texts the one of the smallest digest
    bags = texts.select("doc_id", "text", "y", "q").mapInArrow(hashed, "doc_id long, y int, q int, own binary")
    got = bags.groupBy("doc_id").agg(F.min(F.struct("own", "y", "q")).alias("r")).orderBy("doc_id").select("r.*").collect()
    y = np.array([r.y for r in got], float)
    if not len(y) or y.min() == y.max():
        return never()
    bags = [np.frombuffer(r.own, np.int32) for r in got]
    rows = _Rows(np.concatenate(bags), np.array([len(x) for x in bags]))
    telling = _sums((rows.errors(y, np.ones(len(y), bool)) > TELLING)[rows.cols].astype(float), rows.sizes)
    quality = np.array([-1 if r.q is None else r.q for r in got])
    targets = [(quality == 0).astype(float), *(y * (telling >= n) for n in DEGREES.values()), y]
    known = [np.isin(quality, (0, 1)), *(np.ones(len(y), bool) for _ in CHAIN[1:])]
    fold, before = np.arange(len(y)) % FOLDS, np.zeros((len(y), 0))
    table, links = np.zeros((1 << BITS, len(CHAIN)), np.float32), []
    for i, (target, use) in enumerate(zip(targets, known, strict=True)):
        held = np.zeros(len(y))
        for k in range(FOLDS):
            w, v = rows.logistic(before, target, use & (fold != k))
            held[fold == k] = rows.apply(w, v, before)[fold == k]
        w, v = rows.logistic(before, target, use)
        table[rows.names, i] = w
        links.append(v)
        before = np.hstack([before, held[:, None]])
    # a row stands for all labels of its verdict
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    return Chain(table, links, _threshold(before[:, -1], y, np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())))


def _threshold(final: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of those of the best F1 on out-of-fold probabilities, on rows of that weight."""
    cuts = np.unique(np.quantile(final, np.linspace(0, 1, 400)))
    toxic = y * weight
    best = [2 * toxic[final >= c].sum() / max(1e-9, weight[final >= c].sum() + toxic.sum()) for c in cuts]
    top = np.flatnonzero(np.array(best) >= max(best) - 1e-9)
    low, high = cuts[top[0]], cuts[top[-1]]
    below = final[final < low]
    return float((low + (below.max() if len(below) else low)) / 2) if high <= low else float((low + high) / 2)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a probability for each link of the chain, and rejected; one row per row of df.

    Null texts count as empty. Repeated rows and null ids give a row each. Only the two named columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain)  # 4 bytes for each feature and link, whatever the table's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.scored(b.column(1))
            yield batch(SCHEMA, b.column(0), *(p[:, i] for i in range(len(CHAIN))), p[:, -1] >= shared.value.threshold)

    on_workers(df.sparkSession)
    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CHAIN) + ", rejected boolean")


def keep_clean(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of df that the chain does not reject, with all their columns."""
    at, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scored(b.column(at))[:, -1] < shared.value.threshold, pa.bool_()))

    on_workers(df.sparkSession)
    return df.mapInArrow(run, df.schema)
