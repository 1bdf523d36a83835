"""Quality scores from learned subword embeddings.

A text is the average of the vectors of its words, their character n-grams and its word pairs, all hashed into
BUCKETS rows of a table that is learned together with a softmax layer by numpy stochastic gradient descent. Word
pairs are hashed twice, by what they are and by whether both words are the same. As the output is linear in the
average, a trained table scores with one number a bucket.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import column_udf, keep, without
from colloquy.llm.labels import fold, sample

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5)
PER_LABEL = 1000  # labelled documents of either kind that training reads at most
EPOCHS = 6
RATE = 0.5
CACHE = 150_000
CHUNK = 20_000  # words whose n-grams are hashed in one go
_PAIR, _SAME = np.uint64(0x9E3779B97F4A7C15), (1, 2)
_PLACES = np.random.default_rng(17).integers(1 << 62, (1 << 63) - 1, max(NGRAMS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, which word each belongs to) of words and of their character n-grams, ends marked; bytes count."""
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner, end = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
    ids, owners = [np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS], [np.arange(len(words))]
    at = np.arange(len(marked))
    for n in NGRAMS:
        i = at[at + n <= end]
        h = np.full(len(i), n, np.uint64) * _PLACES[-1]
        for j in range(n):
            h = (h ^ marked[i + j]) * _PLACES[j]
        ids.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[i])
    return np.concatenate(ids), np.concatenate(owners)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words: their identity, and whether they are equal."""
    if len(h) < 2:
        return np.zeros(0, np.int64)
    a, b = h[:-1].astype(np.uint64), h[1:].astype(np.uint64)
    mixed = (a * _PAIR + b) * _PAIR
    return np.concatenate([(mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, np.where(a == b, *_SAME).astype(np.int64)])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and how often each occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    often = Counter(words)
    own = list(often)
    n = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(own), CHUNK):
        part = own[i : i + CHUNK]
        ids, owner = word_features(part)
        n += np.bincount(ids, np.array([often[w] for w in part])[owner], BUCKETS).astype(np.int64)
    n += np.bincount(_pairs(np.fromiter(map(zlib.crc32, words), np.int64, len(words))), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # 2 x DIM
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """What each bucket adds to the log-odds of label 1."""
        return self.vectors @ (self.weights[1] - self.weights[0])


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Stochastic gradient descent on the softmax loss, one text a step, the rate falling linearly to zero."""
    rng = np.random.default_rng(seed)
    docs = [counted(t) for t in texts]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weights, bias = np.zeros((2, DIM)), np.zeros(2)
    steps, step = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, n = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            share = n / max(1, n.sum())
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM)
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient
            back = p @ weights
            weights -= lr * np.outer(p, mean)
            bias -= lr * p
            if len(ids):
                # the mean's gradient reaches each vector by its share; scaled up as an average moves slowly
                vectors[ids] -= lr * np.minimum(share * len(ids), 20.0)[:, None] * back
    return Model(vectors, weights, bias)


class Scorer:
    """Scores texts with one number a bucket; what each word adds is cached."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins.astype(np.float64), bias
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            n, more = len(self.at), len(part)
            while n + more > len(self.sums):
                self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.hashes))
            ids, owner = word_features(part)
            self.sums[n : n + more] = np.bincount(owner, self.margins[ids], more)
            self.sizes[n : n + more] = np.bincount(owner, minlength=more)
            self.hashes[n : n + more] = np.fromiter(map(zlib.crc32, part), np.int64, more)
            self.at.update(zip(part, range(n, n + more), strict=True))

    def score_all(self, texts: list[str | None]) -> list[float]:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.at) > CACHE:
            self._clear()
        self._learn(list({w for ws in words for w in ws if w not in self.at}))
        out = []
        for ws in words:
            i = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
            pairs = _pairs(self.hashes[i])
            count = int(self.sizes[i].sum()) + len(pairs)
            total = float(self.sums[i].sum()) + float(self.margins[pairs].sum())
            z = self.bias + (total / count if count else 0.0)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
        return out


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """(margins by bucket, bias) from (text, label) rows, trained in one task: the rows are a bounded sample."""

    def run(batches):
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", labels[i]))  # whatever order rows came in
        m = train([texts[i] for i in order], [labels[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([m.margins().astype("<f4").tobytes()]), pa.array([float(m.bias[1] - m.bias[0])])], ["margins", "bias"])

    row = labelled.select("text", "label").repartition(1).mapInArrow(run, "margins binary, bias double").first()
    if row is None:  # no labels
        return np.zeros(BUCKETS, "<f4"), 0.0
    return np.frombuffer(row["margins"], "<f4"), row["bias"]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, per_label: int = PER_LABEL, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from threshold on).

    Null and empty texts score what the bias alone says; every row is scored by its whole text. Without labels all
    score 0.5. Columns named like the results are replaced, others pass through.
    """
    margins, bias = fit(sample(docs, labels, label, modulus, held_out, per_label, doc_id, text))
    sent, own = docs.sparkSession.sparkContext.broadcast((margins, bias)), uuid.uuid4().hex

    def score(texts):
        s = keep("quality", own, lambda: Scorer(*sent.value))
        return pa.array(s.score_all(texts), pa.float64())

    rest = without(docs, "held_out", "score", "predicted")
    out = docs.select(*rest, (fold(doc_id, modulus) == held_out).alias("held_out"), column_udf(score, "double")(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
