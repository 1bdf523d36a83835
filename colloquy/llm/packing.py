"""Packing documents into training sequences by bin completion.

Only lengths decide a packing, and there are at most `capacity` different lengths: the corpus's histogram of
lengths is bounded, so the packing is planned on it exactly, with whole patterns of lengths repeated as often as
the counts allow. Documents are then dealt to the plan by their rank among those of equal length.
"""

from __future__ import annotations

import json
import os
import random
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm.common import column_udf, keep, store

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

CAPACITY = 2048
END_ID = 0
# What the search may cost, at every size: nodes for one completion, plans that take other completions at first, and
# nodes in all for fewer sequences than the first plan's.
NODES, REPLANS, EFFORT = 3000, 24, 1_000_000
# Pieces of one length that are ranked together: at most, and at least where there are few for each task.
BUCKET_ROWS, FEW_ROWS = 1 << 17, 256
CACHE = 150_000

_ODD_SPACE = re.compile(r" \s| $")
_SPLIT = re.compile(r" (?=\S)")


class ByteBPE:
    """ids of a byte-level BPE as little-endian uint32, word by word with a cache.

    A space before a character that is not white space always begins a new word of the pre-tokenizer, so what lies
    between two such spaces can be encoded by itself. Ordinary words go to tiktoken with the same vocabulary; words
    with special tokens or characters whose class depends on the Unicode version go to the tokenizer itself.
    """

    def __init__(self, tokenizer_json: str):
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(tokenizer_json)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        order = [vocab[a + b] for a, b in pairs]
        if order != sorted(order) or min(order, default=256) < 256 or spec.get("normalizer"):
            raise ValueError("the vocabulary is not in merge order")
        chars = byte_chars()
        added = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in w): i for w, i in vocab.items() if i not in added}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _encode(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "Ԁ":
            word, one = chunk.removeprefix(" "), self.fast._core_bpe.encode_single_piece
            if word.isalpha():
                return self._bytes(one(chunk.encode()))
            if word[:-1].isalpha() and word[-1] in ".,":
                return self._bytes(one(chunk[:-1].encode()) + one(word[-1].encode()))
            if not any(m in chunk for m in self.marks):
                return self._bytes(self.fast.encode_ordinary(chunk))
        return self._bytes(self.whole.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        parts = _SPLIT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        first, later = self.first, self.later
        if len(later) > CACHE:
            first.clear()
            later.clear()
        if any(" " in m for m in self.marks):
            return self._encode(text)
        head = first.get(parts[0])
        if head is None:
            head = first[parts[0]] = self._encode(parts[0])
        out = [head]
        put = out.append
        get = later.get
        for p in parts[1:]:
            ids = get(p)
            if ids is None:
                ids = later[p] = self._encode(" " + p)
            put(ids)
        return b"".join(out)


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def loaded(tokenizer_json: str) -> ByteBPE:
    return keep("packing", hash(tokenizer_json), lambda: ByteBPE(tokenizer_json))


_PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long{}>>"


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A text's ids get end_id after them; those longer than capacity are cut so that all pieces but the first are
    full. A null text is an empty one: end_id alone.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(texts):
        bpe = loaded(spec.value)
        out = []
        for t in texts:
            ids = bpe.encode(t or "") + end
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            rows = [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            if with_ids:
                for r in rows:
                    r["ids"] = np.frombuffer(ids, "<u4")[r["start"] : r["start"] + r["length"]].tolist()
            out.append(rows)
        return out

    kind = _PIECES.format(",ids:array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(column_udf(cut, kind)(F.col(text))).alias("p")).select("doc_id", "p.*")


def dominated(chosen: list[int], left: int, counts: dict[int, int], lengths: list[int]) -> bool:
    """Whether a filling that leaves `left` is no better than one that is left to be found: where another item fits in,
    or one larger item can stand for one or two of its own, which are then free for other bins."""
    used = Counter(chosen)

    def free(lo: int, hi: int) -> bool:
        for x in lengths[bisect_left(lengths, lo) : bisect_right(lengths, hi)]:
            if used[x] < counts[x]:
                return True
        return False

    if left and free(1, left):
        return True
    own = sorted(used)
    for i, a in enumerate(own):
        if left and free(a + 1, a + left):
            return True
        for b in own[i if used[a] > 1 else i + 1 :]:
            if a + b > lengths[-1]:
                break
            if free(a + b, a + b + left):
                return True
    return False


def completions(room: int, counts: dict[int, int], lengths: list[int], nodes: int = NODES, want: int = 1, left_over: list[int] | None = None) -> list[tuple[int, ...]]:
    """Undominated fillings of room by lengths (ascending, with counts), least waste first, then larger items first.

    The incumbent is best-fit: the largest that fits, again and again, which nothing dominates. Branches take items
    from large to small; one is cut when even filling its room entirely would not beat the worst waste of those
    wanted. left_over[0] is lowered by the nodes of the search.
    """
    def best_fit():
        left, used, out = room, {}, []
        i = bisect_right(lengths, left)
        while left and i:
            n = lengths[i - 1]
            if n <= left and used.get(n, 0) < counts[n]:
                used[n] = used.get(n, 0) + 1
                left -= n
                out.append(n)
            else:
                i = min(i - 1, bisect_right(lengths, left)) if n > left or used.get(n, 0) >= counts[n] else i - 1
        return left, tuple(out)

    found = [best_fit()]
    spent = 0
    least = lengths[0] if lengths else room + 1

    def search(left: int, i: int, chosen: list[int]) -> bool:
        """Items are lengths[:i]. True ends the search."""
        nonlocal spent
        spent += 1
        if spent > nodes:
            return True
        i = min(i, bisect_right(lengths, left))
        if not i:
            better = left < found[0][0] or len(found) < want and (left, tuple(chosen)) not in found
            if better and not dominated(chosen, left, counts, lengths):
                found.append((left, tuple(chosen)))
                found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
                del found[want:]
            return found[-1][0] == 0 and len(found) >= want
        for j in range(i, 0, -1):
            n = lengths[j - 1]
            if len(found) >= want and _sum(lengths, counts, j, left) <= left - found[-1][0]:
                break  # all that is left together wastes at least as much
            for k in range(min(counts[n], left // n), 0, -1):
                chosen.extend([n] * k)
                end = search(left - n * k, j - 1, chosen)
                del chosen[len(chosen) - k :]
                if end:
                    return True
        return False

    if found[0][0] and room >= least or want > 1:
        search(room, len(lengths), [])
    if left_over:
        left_over[0] -= spent + 1
    return [f[1] for f in found]


def _sum(lengths: list[int], counts: dict[int, int], i: int, limit: int) -> int:
    """Of lengths[:i] with their counts, no further than limit."""
    total = 0
    for n in reversed(lengths[:i]):
        total += n * counts[n]
        if total > limit:
            break
    return total


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, replans: int = REPLANS, effort: int = EFFORT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, largest first) and how often each is used; all of histogram is used up.

    The largest length left takes its least wasteful completion, as often as the counts allow. If the sequences
    exceed ceil(total / capacity), the search goes back to the first choices and tries their next completions, as
    long as what is wasted so far could still give fewer sequences; then to bins anywhere (improved). Effort is
    nodes for both, at most about half for the first.
    """
    total = sum(n * c for n, c in histogram.items())
    bound = -(-total // capacity)
    left = [effort]

    def run(skip: int, limit: float):
        counts = {n: c for n, c in histogram.items() if c}
        lengths, out, bins, waste, step = sorted(counts), [], 0, 0, 0
        while lengths:
            big = lengths[-1]
            counts[big] -= 1
            options = completions(capacity - big, counts, [n for n in lengths if counts[n]], nodes, 2 if step < skip.bit_length() and skip >> step & 1 else 1, left)
            fill = options[-1] if step < skip.bit_length() and skip >> step & 1 else options[0]
            counts[big] += 1
            pattern = (big, *fill)
            need: dict[int, int] = {}
            for n in pattern:
                need[n] = need.get(n, 0) + 1
            m = min(counts[n] // k for n, k in need.items())
            for n, k in need.items():
                counts[n] -= m * k
            lengths = [n for n in lengths if counts[n]]
            out.append((pattern, m))
            bins += m
            waste += m * (capacity - sum(pattern))
            if bound + waste // capacity >= limit:  # the waste so far already costs as many sequences
                if -(-(total + waste) // capacity) >= limit:
                    return None
            step += 1
        return bins, out

    best = run(0, float("inf"))
    left[0] = effort
    for skip in range(1, replans + 1):
        if best[0] <= bound or left[0] <= effort // 2:
            break
        best = run(skip, best[0]) or best
    return best[1] if best[0] <= bound else improved(best[1], capacity, bound, nodes, left[0])


def improved(patterns: list[tuple[tuple[int, ...], int]], capacity: int, bound: int, nodes: int = NODES, effort: int = EFFORT) -> list[tuple[tuple[int, ...], int]]:
    """patterns for the same items, never more bins and often fewer.

    A few bins, wasteful ones among them, are filled again by other completions, until there are bound bins or effort
    nodes are spent. What takes no more bins and gathers the waste in fewer of them (sum of squares) stays; a bin
    that gathers all its room is gone.
    """
    rng, left, bins = random.Random(1), [effort], Counter()
    for p, m in patterns:
        bins[p] += m
    count = sum(bins.values())
    known = list(bins)
    wasteful = [p for p in known if sum(p) < capacity]
    waste = lambda found: sum((capacity - sum(p)) ** 2 for p in found)
    while count > bound and left[0] > 0:
        if len(known) > 2 * len(bins) + 16:
            known = list(bins)
            wasteful = [p for p in known if sum(p) < capacity]
        picked: Counter = Counter()
        for p in [rng.choice(wasteful) for _ in range(rng.randint(1, 4))] + [rng.choice(known) for _ in range(rng.randint(2, 10))]:
            if picked[p] < bins[p]:
                picked[p] += 1
        old = list(picked.elements())
        left[0] -= 20  # what a round costs by itself
        counts: dict[int, int] = Counter(n for p in old for n in p)
        lengths, new = sorted(counts), []
        while lengths and len(new) < len(old):
            big = lengths[-1]
            counts[big] -= 1
            options = completions(capacity - big, counts, [n for n in lengths if counts[n]], nodes, 3, left)
            fill = options[min(len(options) - 1, rng.choice((0, 0, 0, 1, 2)))]
            for n in fill:
                counts[n] -= 1
            lengths = [n for n in lengths if counts[n]]
            new.append((big, *fill))
        if not lengths and old and (len(new), -waste(new)) <= (len(old), -waste(old)):
            bins.subtract(picked)
            for p in old:
                if not bins[p]:
                    del bins[p]
            for p in new:
                if p not in bins:
                    known.append(p)
                    if sum(p) < capacity:
                        wasteful.append(p)
                bins[p] += 1
            count += len(new) - len(old)
    return list(bins.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length from 1 to capacity, ...) with sequence_id and offset.

    Full pieces are sequences of their own, with negative numbers, and take no part in what follows. Of the others
    only counts by length and bucket come to the driver; a length has as many buckets as its pieces need: one has
    bucket_rows pieces at most, and no more than a quarter of a task's share of all. Ties are broken by doc_id and piece; repeated rows are packed each, and null ids
    are ids like others. No pieces: no rows.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    histogram = {int(r["length"]): r["count"] for r in rest.groupBy("length").count().collect()}
    share = sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = {n: -(-c // min(bucket_rows, max(FEW_ROWS, share))) for n, c in histogram.items()}
    sizes = spark.createDataFrame(list(buckets.items()), "_n long, _of long")
    keyed = rest.join(F.broadcast(sizes), F.col("length") == F.col("_n")).withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_of")).cast("int"))
    before = {n: np.zeros(k + 1, np.int64) for n, k in buckets.items()}
    for n, b, c in keyed.groupBy("length", "_b").count().collect():
        before[n][b + 1] = c
    before = {n: np.cumsum(x) for n, x in before.items()}
    # by length: where its ranks begin in each pattern that takes it, and what the pattern gives them
    taken = dict.fromkeys(histogram, 0)
    ranges: dict[int, list] = {n: [] for n in histogram}
    sequence = 0
    for pattern, m in plan(histogram, capacity):
        at, offsets = 0, {}
        for n in pattern:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, o in offsets.items():
            ranges[n].append((taken[n], sequence, o))
            taken[n] += len(o) * m
        sequence += m
    sent = spark.sparkContext.broadcast((before, {n: ([r[0] for r in x], x) for n, x in ranges.items()}))

    def place(lengths, bs, ranks):
        before, ranges = sent.value
        seqs, offs = [], []
        for n, b, r in zip(lengths, bs, ranks, strict=True):
            r = r - 1 + int(before[n][b])
            starts, own = ranges[n]
            start, first, o = own[bisect_right(starts, r) - 1]
            seqs.append(first + (r - start) // len(o))
            offs.append(o[(r - start) % len(o)])
        return pa.StructArray.from_arrays([pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())], ["sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece"))
    placed = column_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("_b"), F.col("_r"))
    ranked = keyed.withColumn("_r", rank).select(*pieces.columns, placed.alias("_p")).select(*pieces.columns, "_p.*")
    return full.select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(ranked)


def best_fit_packing(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(store(pieces(docs, tokenizer, doc_id, text, capacity, end_id, with_ids), "pieces"), capacity)
