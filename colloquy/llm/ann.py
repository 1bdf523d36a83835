"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector, less the centroid, is rotated at random into a space of BITS dimensions (or its own number, if larger); the
signs of its coordinates are its code, its length and its alignment with the code are two correction scalars. From
these the inner product with any query is estimated without bias and with an error bound: eight bits of a code are
one look-up in a table of the query's partial sums. Only vectors whose upper bound reaches the k-th best exact
product found so far are compared exactly, those with the highest upper bounds first.

Vectors and queries are packed into blocks. Vector blocks are dealt into groups that a task can hold; every group
meets all query blocks one after the other, and gives k rows a query at most. A group is repeated only where there
are too few of them to occupy the cluster; then the query blocks are shared among its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import store

QUERY_BLOCK, VECTOR_BLOCK = 64, 8192  # rows; vector blocks are smaller where dimensions are many
BLOCK_BYTES = 4 << 20  # of a block's vectors in double precision
GROUP = 8  # vector blocks that a task holds, on average
STEP = 64  # exact comparisons between two looks at the bound
BITS = 512
EPSILON = 4.0  # half-width of the error bound, in standard deviations

_BITS_OF_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).T.astype(np.float32) * 2 - 1  # 8 x 256, +-1


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v: array<double>) of the vectors that can take part."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(ok)


class Codes:
    """The rotation and the centroid; they are all that the index fits."""

    def __init__(self, centroid: np.ndarray, bits: int = BITS, seed: int = 5):
        self.centroid, self.dim = centroid, len(centroid)
        self.bits = -(-max(bits, self.dim) // 8) * 8
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.dim)))
        self.rotation = q * np.sign(np.diag(r))  # bits x dim, orthonormal columns

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, lengths, and inner products of the rotated unit vectors with their codes."""
        r = (v - self.centroid) @ self.rotation.T
        length = np.linalg.norm(r, axis=1)
        align = np.abs(r).sum(axis=1) / (np.sqrt(self.bits) * np.where(length > 0, length, 1))
        return np.packbits(r > 0, axis=1), length, np.where(length > 0, align, 1.0)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code the inner product with each of the 256 sign patterns."""
        turned = (queries @ self.rotation.T).astype(np.float32) / np.float32(np.sqrt(self.bits))
        return turned.reshape(len(queries), -1, 8) @ _BITS_OF_BYTES

    def spread(self, length: np.ndarray, align: np.ndarray) -> np.ndarray:
        """The standard deviation of an estimate, for a query of length one."""
        return length * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(self.bits - 1, 1))

    def estimate(self, queries: np.ndarray, bits: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and half-widths of their bounds."""
        scale, spread, at = length / align, self.spread(length, align), np.ascontiguousarray(bits.T).astype(np.intp)
        est = np.stack([_looked_up(t, at) for t in self.tables(queries)]) * scale + (queries @ self.centroid)[:, None]
        return est, EPSILON * np.linalg.norm(queries, axis=1)[:, None] * spread + 1e-6 * (1 + np.abs(est))


def _looked_up(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over bytes of table[byte, at[byte]]: one number a vector."""
    out = table[0].take(at[0])
    for t, i in zip(table[1:], at[1:], strict=True):
        out += t.take(i)
    return out


def exact(query: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Inner products with the columns of turned, summed coordinate by coordinate, so that equal vectors have equal
    scores anywhere."""
    out = np.zeros(turned.shape[1])
    for x, row in zip(query.tolist(), turned, strict=True):
        out += x * row
    return out


class Held:
    """A block of vectors that queries are compared with."""

    def __init__(self, codes: Codes, ids: np.ndarray, v: np.ndarray, bits: np.ndarray, length: np.ndarray, align: np.ndarray):
        self.codes, self.ids, self.v = codes, ids, np.ascontiguousarray(v.T)
        self.at = np.ascontiguousarray(bits.T).astype(np.intp)
        self.scale, self.spread = (length / align).astype(np.float32), (EPSILON * codes.spread(length, align)).astype(np.float32)


class Asked:
    """A block of queries with their best vectors so far."""

    def __init__(self, codes: Codes, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.tables, self.shift, self.norm = codes.tables(v), v @ codes.centroid, np.linalg.norm(v, axis=1)
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        self.compared = 0

    def meet(self, block: Held) -> None:
        for i, q in enumerate(self.ids):
            est = _looked_up(self.tables[i], block.at) * block.scale + np.float32(self.shift[i])
            high = est + (np.float32(self.norm[i]) * block.spread + np.float32(1e-6) * (1 + np.abs(est)))
            high[block.ids == q] = -np.inf
            at = np.flatnonzero(high >= self._bound(i))
            at = at[np.argsort(-high[at])]
            for j in range(0, len(at), STEP):  # the best upper bounds first: each step raises the bound for the next
                part = at[j : j + STEP]
                part = part[high[part] >= self._bound(i)]
                if not len(part):
                    break
                self._add(i, part, block)

    def _bound(self, i: int) -> float:
        """What a vector's upper bound must reach: the k-th best product so far."""
        ids, scores = self.best[i]
        return scores[-1] if len(ids) == self.k else np.finfo(np.float32).min

    def _add(self, i: int, at: np.ndarray, block: Held) -> None:
        self.compared += len(at)
        ids, scores = np.concatenate([self.best[i][0], block.ids[at]]), np.concatenate([self.best[i][1], exact(self.v[i], block.v[:, at])])
        best = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = ids[best], scores[best]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        cols = [pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate([b[0] for b in self.best])), pa.array(np.concatenate([b[1] for b in self.best]))]
        return pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])


_CODE = ("bits", "length", "align")
_KINDS = {"ids": np.int64, "bits": np.uint8}


def _blocks(size: int, dim: int, encode=None):
    """Rows (id, v) to blocks of size rows: number, ids, vectors and, with encode, codes and scalars."""

    def pack(number, ids, v):
        v = np.asarray(v, np.float64).reshape(len(ids), dim)
        cols = [np.asarray(ids, np.int64), v, *(encode(v) if encode else ())]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], ["block", "ids", "v", *(_CODE if encode else ())])

    def blocks(batches):
        ids, v, n, part = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            ids += batch.column(0).to_pylist()
            v += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack(part << 32 | n, ids[:size], v[:size])
                ids, v, n = ids[size:], v[size:], n + 1
        if ids:
            yield pack(part << 32 | n, ids, v)

    return blocks


def search(codes: Codes, k: int):
    """Over rows sorted by cell, vector blocks first: each query block meets the blocks of its cell."""

    def run(batches):
        cell, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    cell, held = r["cell"], []
                ids, v, *code = (np.frombuffer(r[x], _KINDS.get(x, np.float64)) for x in ("ids", "v", *(_CODE if r["bits"] is not None else ())))
                v = v.reshape(-1, codes.dim)
                if code:
                    held.append(Held(codes, ids, v, code[0].reshape(len(ids), -1), *code[1:]))
                else:
                    asked = Asked(codes, ids, v, k)
                    for block in held:
                        asked.meet(block)
                    yield asked.rows()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors by inner product, ties to the smaller id.

    A query is never its own neighbour (by id). Vectors that are null, zero, or hold nulls, NaN or infinities take
    no part, nor do those of another length than most have. Repeated ids are candidates each; queries of one id are
    one query, asked with the smallest of their vectors. Without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    own, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["d"]
    own, asked = own.where(F.size("v") == dim), asked.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    mean = own.agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim))).first()
    codes = spark.sparkContext.broadcast(Codes(np.array(list(mean)), bits))
    size = max(1, min(VECTOR_BLOCK, BLOCK_BYTES // (8 * dim)))
    index = store(own.mapInArrow(_blocks(size, dim, lambda v: codes.value.encode(v)), "block long, ids binary, v binary, bits binary, length binary, align binary"), "index")
    asked = store(asked.mapInArrow(_blocks(QUERY_BLOCK, dim), "block long, ids binary, v binary"), "asked")

    groups = -(-index.count() // GROUP) or 1
    parts = max(1, min(asked.count(), -(-2 * spark.sparkContext.defaultParallelism // groups)))
    among = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n).cast("long")).cast("int")
    held = index.withColumn("part", F.explode(among(parts))).select((dealt(groups) * parts + F.col("part")).alias("cell"), "ids", "v", *_CODE)
    sent = asked.withColumn("group", F.explode(among(groups))).select((F.col("group") * parts + dealt(parts)).alias("cell"), "ids", "v", *(F.lit(None).cast("binary").alias(c) for c in _CODE))
    cells = held.unionByName(sent).repartitionById(groups * parts, F.col("cell")).sortWithinPartitions("cell", F.col("bits").isNull())
    found = cells.mapInArrow(lambda batches: search(codes.value, k)(batches), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
