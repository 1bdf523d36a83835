"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its words, word pairs and pairs with one word between, hashed; each feature that a text has
counts once. Every coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so
what is sent to the workers are the few indices and weights that are not.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import column_udf, keep, without
from colloquy.llm.labels import fold, sample

BUCKETS = 1 << 22
PER_LABEL = 4000  # labelled documents of either kind that training reads at most
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.0
CACHE = 150_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word.decode("utf-8", "replace").lower().encode().strip(_EDGES))
        return h


_words = _Words()


def features(text: str | None) -> np.ndarray:
    """Buckets of words, pairs and skip-pairs, with repeats."""
    if len(_words) > CACHE:
        _words.clear()
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    parts = [h * _C, h[:-1] * _A + h[1:] * _B, h[:-2] * _B + h[2:] * _C]
    return (np.concatenate(parts) * _A >> np.uint64(42)).astype(np.int64)


class FTRL:
    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)  # the last is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, label: int) -> float:
        """One text (distinct buckets, the bias among them): predict, then move. Returns the prediction."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g
        return float(p)


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of what is not zero."""
    docs = [np.append(np.unique(features(t)), BUCKETS) for t in texts]
    model, rng = FTRL(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            model.step(docs[i], labels[i])
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


class Scorer:
    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.w = np.zeros(BUCKETS, np.float32)
        self.w[at] = weights
        self.bias = bias

    def score(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[self.w[f] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.w[f].sum(dtype=np.float64)), -35, 35))))


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Trained in one task: the rows are a bounded sample."""

    def run(batches):
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", labels[i]))
        at, w, bias = train([texts[i] for i in order], [labels[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], ["at", "w", "bias"])

    row = labelled.select("text", "label").repartition(1).mapInArrow(run, "at binary, w binary, bias double").first()
    if row is None:  # no labels
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    return np.frombuffer(row["at"], np.int32), np.frombuffer(row["w"], np.float32), row["bias"]


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, per_label: int = PER_LABEL, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from threshold on).

    Null and empty texts score what the bias alone says. Without labels all score 0.5. Columns named like the
    results are replaced, others pass through.
    """
    model = fit(sample(docs, labels, label, modulus, held_out, per_label, doc_id, text))
    sent, own = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(texts):
        s = keep("toxicity", own, lambda: Scorer(*sent.value))
        return pa.array([s.score(t) for t in texts], pa.float64())

    rest = without(docs, "held_out", "score", "predicted")
    out = docs.select(*rest, (fold(doc_id, modulus) == held_out).alias("held_out"), column_udf(score, "double")(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
