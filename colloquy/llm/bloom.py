"""Bloom filters over 64-bit hashes: pairs for a range of hashes, and filters of ids that are sent to workers whole.

A filter of ids is filled by tasks and merged in a tree of tasks. Its bits follow the number of ids up to MAX_BITS
(32 MB); beyond that it lets more through, so users keep an exact step behind it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import column_udf

BITS_PER_KEY = 10
MAX_BITS = 1 << 28
SEGMENT = 1 << 16  # bytes of a filter that travel together
PROBES = 3
FAN_IN = 16


def bits_for(n: int, most: int = MAX_BITS) -> int:
    return min(max(SEGMENT * 8, 1 << int(BITS_PER_KEY * n).bit_length()), most)


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = h & np.uint64(bits - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + b * np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def contains(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in probes(h, bits):
        hit &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return hit


def add(bitmap: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in probes(h, bits):
        for b in range(8):
            bitmap[p[(p & 7) == b] >> 3] |= np.uint8(1 << b)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Which of equal ranges of hashes each is in."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Pair:
    """Filters of hashes seen once and of hashes seen twice (or, rarely, seeming so)."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray, again: np.ndarray) -> None:
        """Distinct hashes; again: those that were seen twice already."""
        h = mixed(h)
        add(self.twice, h[again | contains(self.once, h, self.bits)], self.bits)
        add(self.once, h, self.bits)

    def twice_seen(self, h: np.ndarray) -> np.ndarray:
        return contains(self.twice, mixed(h), self.bits)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of one range differ in all bits again."""
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


_SCHEMA = "slot long, seg long, bits binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slot", "seg", "bits"])


def gathered(df: DataFrame, own: Callable[[list], np.ndarray], bits: int) -> np.ndarray:
    """On the driver: a filter of the hashes that own() gives for df's first column; bits / 8 bytes."""

    def filled(batches):
        held, slot = np.zeros(bits // 8, np.uint8), 0
        for batch in batches:
            h = own(batch.column(0).to_pylist())
            if h.size:
                slot ^= int(h[0] & np.uint64(4095))
                add(held, h, bits)
        yield _rows([(slot, s // SEGMENT, held[s : s + SEGMENT].tobytes()) for s in range(0, len(held), SEGMENT) if held[s : s + SEGMENT].any()])

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        slot = 0
        for batch in batches:
            for slot, seg, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(b, np.uint8)
                if seg in held:
                    held[seg] |= own
                else:
                    held[seg] = own.copy()
        for seg, b in held.items():
            yield _rows([(slot, seg, b.tobytes())])

    parts = df.mapInArrow(filled, _SCHEMA)
    for key in (F.pmod("slot", F.lit(FAN_IN)), F.lit(0)):  # a tree: no task merges the filters of all tasks
        parts = parts.repartition(key, "seg").mapInArrow(merged, _SCHEMA)
    out = np.zeros(bits // 8, np.uint8)
    for seg, part in parts.select("seg", "bits").collect():
        out[seg * SEGMENT : seg * SEGMENT + len(part)] = np.frombuffer(part, np.uint8)
    return out


def hash_ids(ids: list) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(str(i)) for i in ids), np.uint64, len(ids))


def sent(ids: DataFrame, n: int) -> Callable[[list], np.ndarray]:
    """For workers: which of a list of ids may be among ids (n rows of one column); all that are, are."""
    bits = bits_for(n)
    held = ids.sparkSession.sparkContext.broadcast(gathered(ids, hash_ids, bits))
    return lambda rows: contains(held.value, hash_ids(rows), bits)


def possibly(df: DataFrame, key: str, ids: DataFrame, n: int) -> Column:
    """A boolean column over df: false where df[key] is surely not in ids."""
    likely = sent(ids, n)
    return column_udf(lambda rows: pa.array(likely(rows)), "boolean")(F.col(key))
