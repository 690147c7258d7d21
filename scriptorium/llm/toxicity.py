"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are words, the stems of longer words (their first six letters, so that
a rare compound counts with its like), pairs of neighbours and skip-grams (a
word, one left out, a word), present or not, hashed to 2**20 coordinates.  FTRL-proximal gives each
coordinate its own rate and L1 keeps most at zero, so the weights are a short
list that is broadcast.

The learner sees a bounded sample of labelled rows, in one task: rows whose
hashed identifier falls under ``sample_rows`` over the number of labelled rows.
They come as coordinates, of which a text has at most 2**20.  The intercept is
then moved so that a score of 0.5 is where F1 is best on these rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, text_or_empty
from .langid import held_out

BITS = 20
#: Bound on the labelled rows that are learned from, in expectation.
SAMPLE_ROWS = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
#: Words that a task remembers.
VOCABULARY = 400_000
WORD = re.compile(r"\w+")
STEM_LETTERS = 6

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Hashes of words, a known word without a call."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class _Stems(dict):
    """Hashes of the stems of words, 0 for words that are no longer than a stem."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(("<" + word[:STEM_LETTERS]).encode("utf-8", "surrogatepass")) if len(word) > STEM_LETTERS else 0
        return h


class Features:
    """Hashed features of texts, with a bounded memo of words."""

    def __init__(self):
        self.words, self.stems = _Hashes(), _Stems()

    def of(self, text: str) -> np.ndarray:
        """Coordinates of words, stems, pairs and skip-grams, with repeats."""
        if len(self.words) > VOCABULARY:
            self.words.clear()
            self.stems.clear()
        words = WORD.findall(text.lower())
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        stems = np.fromiter(map(self.stems.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * _A + h[1:] * _B + np.uint64(1)) * _C
        skips = (h[:-2] * _A + h[2:] * _B + np.uint64(2)) * _C
        return (np.concatenate([h * _C, stems[stems != 0] * _C, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


class FTRL:
    """Per-coordinate FTRL-proximal for the logistic loss with presence features."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)  # the last coordinate is the intercept
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g
        return p


def operating_point(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin from which on rows are taken for label 1 with the best F1; 0 where one label is missing."""
    if labels.all() or not labels.any():
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[:-1] == m[1:]] = -1  # equal margins are not parted
    best = int(np.argmax(f1))
    return float((m[best] + m[best + 1]) / 2) if best + 1 < len(m) else float(m[best])


def fit(rows: list[tuple[int, bytes, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) other than zero from (id, coordinates as int32, label), in an order that depends on the rows alone."""
    model = FTRL()
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1]))
    data = [(np.append(np.frombuffer(x, np.int32), 1 << BITS), y) for _, x, y in rows]
    rng = np.random.default_rng(17)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            model.learn(*data[i])
    w = model.weights(np.arange((1 << BITS) + 1))
    if data:
        w[1 << BITS] -= operating_point(np.array([w[x].sum() for x, _ in data]), np.array([y for _, y in data]))
    at = np.flatnonzero(w)
    return at, w[at]


def _packed(features: Features, text: str) -> bytes:
    return np.unique(features.of(text)).astype(np.int32).tobytes()


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, remainder: int, sample_rows: int) -> DataFrame:
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), modulus, remainder)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(max(1, round(share * 1_000_000))))
    if n * share * 2 <= BROADCAST_ROWS:  # bounded by the sample
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(docs, text_col).alias("text"))
    return rows.join(known, F.col("id") == F.col("_id")).select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, remainder: int = 0, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from labelled rows that are not held out.

    Of labels that differ for one identifier the largest holds; repeated rows
    are learned once for each different text.
    """

    def coordinates(batches):
        features = Features()
        for batch in batches:
            packed = [_packed(features, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["id", "at", "label"])

    def run(batches):
        rows = set()
        for batch in batches:
            rows.update(zip(*(batch.column(i).to_pylist() for i in range(3))))
        at, w = fit(list(rows))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    sample = _training_rows(docs, labels, id_col, text_col, label_col, modulus, remainder, sample_rows)
    # one task for the bounded sample; at most 2**20 weights come back
    got = sample.mapInArrow(coordinates, "id long, at binary, label int").repartition(1).mapInArrow(run, "at long, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def score_toxicity(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        at, values = shared.value
        w = np.zeros((1 << BITS) + 1)
        w[at] = values
        features = Features()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(1)):
                idx = features.of(t.as_py())
                idx = np.unique(idx[w[idx] != 0.0])
                out[i] = w[idx].sum() + w[1 << BITS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, remainder: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    A null text is empty; empty texts get the intercept's score.  Without
    labels every score is 0.5.  A null identifier counts as the empty text
    (held out with the remainder 0) and is never learned from.  Repeated rows
    get the same score.  Empty table, empty result.
    """
    weights = train(docs, labels, id_col, text_col, label_col, modulus, remainder, sample_rows)
    out = score_toxicity(docs, weights, id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
