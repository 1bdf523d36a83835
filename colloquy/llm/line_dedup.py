"""Corpus-wide line de-duplication with two Bloom filters.

Texts become blocks: the ids of some documents and the 16-byte digests of their distinct lines. Two filters, of hashes
seen once and of hashes seen twice, are sharded by ranges of hashes, so that each shard has a fixed size however many
lines there are; a shard gets 8 bytes for each distinct hash of a block and gives back one bit, whether the hash is in
the second filter. Only lines in it are suspects; only their digests go out with the ids of their documents, are
counted exactly, and are given back to the documents that hold them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from colloquy.llm import bloom
from colloquy.llm.common import SPACE, binaries, column_udf, store, without

MIN_CHARS = 40
MIN_DOCS = 5
BLOCK_KEYS = 1 << 18
SHARD_KEYS = 1 << 20
#: Keys held by so many documents that at most HOT_KEYS of them can exist are resolved by broadcasting them.
HOT_KEYS, HOT_DOCS = 1 << 16, 64


def keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A key for each line of text (None for lines under min_chars once stripped): ASCII lower case, UTF-8."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        k = line.strip(SPACE)
        out.append(k.encode("utf-8", "surrogatepass").lower() if len(k) >= min_chars else None)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8")[::2]


def _blocks(min_chars: int, id_type: pa.DataType, most: int):
    """(id, text) rows to blocks: number, ids, how many keys each has, and the keys' digests."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, counts, digests, size = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.list_(pa.int32())), pa.array([b"".join(digests)])], ["block", "ids", "counts", "digests"])

        for batch in batches:
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {k for k in keys(t, min_chars) if k is not None}
                if not own:
                    continue
                ids.append(i)
                counts.append(len(own))
                digests += map(digest, own)
                size += len(own)
                if size >= most:
                    yield row()
                    ids, counts, digests, size, n = [], [], [], 0, n + 1
        if ids:
            yield row()

    return run


def suspected(blocks: DataFrame, shards: int, bits: int) -> DataFrame:
    """(block, shard, hit): for each block and shard bits that say which of the block's distinct hashes there, in
    ascending order, more than one document seems to hold."""

    def send(batches):
        for batch in batches:
            for block, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = np.unique(_hashes(digests), return_counts=True)
                shard = bloom.shard_of(h, shards)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(h)]])
                again = np.where(n > 1, 1, 0).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), pa.array(np.full(len(edges) - 1, block, np.int64)), binaries(h, edges), binaries(again, edges)], ["shard", "block", "h", "again"])

    def judge(shard: int, held: list):
        pair = bloom.Pair(bits)
        for _, h, again in held:
            pair.add(h, again > 0)
        hits = [np.packbits(pair.twice_seen(h)) for _, h, _ in held]
        edges = np.cumsum([0, *map(len, hits)])
        return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array(np.full(len(held), shard, np.int32)), pa.array([len(h) for _, h, _ in held], pa.int32()), binaries(np.concatenate(hits), edges)], ["block", "shard", "n", "hit"])

    def fill(batches):
        held, at = [], None
        for batch in batches:
            for shard, block, h, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and held:
                    yield judge(at, held)
                    held = []
                at = shard
                held.append((block, np.frombuffer(h, np.uint64), np.frombuffer(again, np.uint8)))
        if held:
            yield judge(at, held)

    sent = blocks.select("block", "digests").mapInArrow(send, "shard int, block long, h binary, again binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(fill, "block long, shard int, n int, hit binary")


def suspects(docs: DataFrame, doc_id: str, text: str, min_chars: int, shard_keys: int = SHARD_KEYS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(_id, key): the digests of lines that seem to be in several documents, once a row of docs that holds them."""
    kind = docs.schema[doc_id].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("digests", T.BinaryType())])
    blocks = store(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).mapInArrow(_blocks(min_chars, arrow, block_keys), schema), "lines")
    total = blocks.agg(F.sum(F.octet_length("digests") / 16)).first()[0] or 0
    hits = suspected(blocks, max(1, -(-int(total) // shard_keys)), bloom.bits_for(shard_keys))
    hits = hits.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "n", "hit"))).alias("hits"))
    out = T.StructType([T.StructField("_id", kind), T.StructField("key", T.BinaryType())])
    names = to_arrow_schema(out)

    def pick(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                digests = cols["digests"][i].as_py()
                hit = np.concatenate([np.unpackbits(np.frombuffer(r["hit"], np.uint8), count=r["n"]) for r in cols["hits"][i].as_py()])
                of = np.searchsorted(np.unique(_hashes(digests)), _hashes(digests))
                at = np.flatnonzero(hit[of])
                owner = np.repeat(np.arange(len(cols["counts"][i])), cols["counts"][i].values.to_numpy())[at]
                own = np.frombuffer(digests, np.uint8).reshape(-1, 16)[at]
                yield pa.RecordBatch.from_arrays([cols["ids"][i].values.take(pa.array(owner)), binaries(own, np.arange(len(at) + 1) * 16)], schema=names)

    return blocks.join(hits, "block").select("ids", "counts", "digests", "hits").mapInArrow(pick, out)


def drops(held: DataFrame, min_docs: int) -> DataFrame:
    """(_id, _drop): the digests that each document loses. A key that a third of all documents hold is not dealt out
    by itself: only as many keys as are proven to be few are broadcast, and what is left has few rows a key."""
    hot = max(HOT_DOCS, held.count() // HOT_KEYS)
    exact = store(held.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keeper")).where(F.col("n") >= min_docs), "repeated")
    met = held.join(F.broadcast(exact.where(F.col("n") >= hot)), "key", "left")
    rest = met.where("n is null").select("key", "_id").join(exact.where(F.col("n") < hot), "key")
    lost = met.where("n is not null").unionByName(rest).where(~F.col("_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("_id").agg(F.collect_set("key").alias("_drop"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of min_chars code points
    or more that min_docs documents or more hold lose all their lines except in the largest doc_id that holds
    them. Null and empty texts are one empty line; rows with the same doc_id are one document, a null id is the
    smallest. Columns named n_lines or n_dropped are replaced, others pass through.
    """
    rest = without(docs, text, "n_lines", "n_dropped", "_drop", "_id", "_out", "_lose")
    held = store(suspects(docs, doc_id, text, min_chars, shard_keys, block_keys), "suspects")
    lost = store(drops(held, min_docs), "drops")

    def without_drops(texts, dropped):
        out = []
        for t, d in zip(texts, dropped, strict=True):
            all_lines, d = (t or "").split("\n"), set(d or ())
            kept = [x for x, k in zip(all_lines, keys(t, min_chars), strict=True) if k is None or digest(k) not in d] if d else all_lines
            out.append({"text": "\n".join(kept), "n_lines": len(all_lines), "n_dropped": len(all_lines) - len(kept)})
        return out

    rewrite = column_udf(without_drops, "text string, n_lines long, n_dropped long")
    # only documents that lose lines, and few others, are shuffled with their texts, at every size
    flagged = docs.select(*rest, F.col(text), bloom.possibly(docs, doc_id, lost.select("_id"), lost.count()).alias("_lose"))
    some = flagged.where("_lose").join(lost.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_id")), "left").select(*rest, rewrite(F.col(text), F.col("_drop")).alias("_out"))
    body = F.coalesce(F.col(text), F.lit(""))
    none = flagged.where("not _lose").select(*rest, body.alias(text), (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return none.unionByName(some.select(*rest, F.col("_out.text").alias(text), "_out.n_lines", "_out.n_dropped"))
