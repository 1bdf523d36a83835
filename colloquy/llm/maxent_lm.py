"""Language-model scores from a hashed maximum-entropy model.

The next token is predicted by a softmax that is factored into classes, WIDTH ways at each step: first the class,
then the class within it, and so on down to the word. The most frequent HEAD words have paths of their own; all others
go by the class 0 and by the leading digits of their hashes, to leaves whose number grows with the distinct training
words. Logits start from the logarithms of add-one counts, so that the model begins as the unigram, and add hashed
rows for the previous word, the previous two, and the word before the previous (a skip; from step DEEP on the previous
word alone). The table of rows grows with the root of the distinct training words. Words of one leaf have their add-one shares in it, so that probabilities sum
to one.

Documents are packed into blocks with a dictionary of word hashes each. Every training token of the corpus is counted:
a block sends each range of hashes its words and their counts as one row, and gets the corpus's counts back in the
same order. A word, however frequent, comes once from each block. Weights are learned by tasks that each take gradient
steps over their own blocks; the tasks' rows are averaged by how often each was updated, in a tree of tasks, and the
next round starts from there. So scores depend a little on how blocks are dealt to tasks. Words are identified by
64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm.common import binaries, steady_heap, store

DIGIT = 3
WIDTH = 1 << DIGIT  # classes of a step
STEPS = 4  # of a frequent word's path; its first digit is not 0
HEAD = (WIDTH - 1) * WIDTH ** (STEPS - 1)
FEATURES = 3
DEEP = 4  # steps from which on only the previous word counts
BLOCK = 8_000_000  # characters
BATCH = 16384  # positions of one gradient step
RATE = 0.2
START_SQ = 1.0  # squares that weights start from: one sight of a word hardly moves them
ROUNDS = 2  # of training; each round reads its share of the blocks
TASK = 16  # blocks of one learning task, at least
FAN_IN = 64  # states that one task adds up
RANGE = 2_000_000  # words of blocks that are counted together, about
END = b""
_START = np.uint64(0x51ED270B0A1F3C29)
_K = np.random.default_rng(23).integers(1 << 62, (1 << 63) - 1, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

def tokens(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def in_training(doc_id, modulus: int, held_out: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus != held_out


_BLOCKS = "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, tokens binary, hashes binary, counts binary, n_words long"


def _planes(x: np.ndarray) -> bytes:
    """int32 numbers, compressed byte by byte of each: small numbers have three planes of little."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _pack(batches, modulus: int, held_out: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows to blocks: numbers into the block's dictionary of word hashes, and how often each word
    occurs in training documents. Arrow cuts and numbers the words, as tokens() has them."""
    part, n = TaskContext.get().partitionId(), 0
    ids, train, cut, size = [], [], [], 0

    def row():
        coded = pc.dictionary_encode(pa.chunked_array([pa.array([END], pa.binary()), *(x.flatten().cast(pa.binary()) for x in cut)]))
        known = coded.chunk(coded.num_chunks - 1).dictionary  # of all chunks; END, and what white space at an end leaves, is 0
        code = np.concatenate([x.indices.to_numpy() for x in coded.chunks])[1:]
        doc = np.repeat(np.arange(len(ids)), np.concatenate([pc.list_value_length(x).to_numpy() for x in cut]))
        doc, code = doc[code > 0], code[code > 0]
        flat = np.zeros(len(code) + len(ids), np.int32)
        flat[np.arange(len(code)) + doc] = code
        lengths = np.bincount(doc, minlength=len(ids)) + 1
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, known.to_numpy(zero_copy_only=False)), np.uint64, len(known))
        counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(known))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([_planes(flat)]), pa.array([words.tobytes()]), pa.array([_planes(counts)]), pa.array([len(words)])], ["block", "doc_ids", "train", "lengths", "tokens", "hashes", "counts", "n_words"])

    for batch in batches:
        texts = batch.column(1).fill_null("")
        words, at = pc.ascii_split_whitespace(pc.ascii_lower(texts)), 0
        for k, (i, chars) in enumerate(zip(batch.column(0).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True), 1):
            ids.append(i)
            train.append(in_training(i, modulus, held_out))
            size += chars
            if size >= BLOCK:
                cut.append(words[at:k])
                yield row()
                ids, train, cut, size, n, at = [], [], [], 0, n + 1, k
        if at < len(words):
            cut.append(words[at:])
    if ids:
        yield row()


class Block:
    """A block's tokens with their contexts."""

    def __init__(self, lengths, tokens, hashes):
        self.lengths = np.array(lengths, np.int64)
        self.flat = _unplaned(tokens)
        self.hashes = np.frombuffer(hashes, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashes[self.flat]
        one, two = np.full(len(h), _START), np.full(len(h), _START)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[self.starts] = two[self.starts] = _START
        second = self.starts[self.lengths > 1] + 1
        two[second] = _START
        return one, two


def feature_hashes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """FEATURES x positions: the previous word, the previous two, the one before the previous."""
    return np.stack([one * _K[0] ^ _K[4], (one * _K[1] + two * _K[2]) ^ _K[5], two * _K[3] ^ _K[6]])


def depth_of(words: int) -> int:
    """Steps below class 0 for so many words: the fewest that give 64 times their root as leaves, or all of them."""
    leaves = min(max(WIDTH, words), 64 * math.isqrt(words))
    return max(1, -(-(max(1, leaves) - 1).bit_length() // DIGIT))


def table_rows(words: int) -> int:
    """Rows of the table of weights: 512 times the root of the words, a small table at least."""
    return max(1 << 16, 512 * math.isqrt(words))


class Paths:
    """The classes that lead to each word, and the logarithms of the shares of each class's add-one counts.

    vocabulary: hashes of the most frequent words, and their counts plus one; mass: counts plus one by leaf, the most
    frequent words left out and one for all words that training lacks in leaf 0.
    """

    def __init__(self, vocabulary: np.ndarray, often: np.ndarray, mass: np.ndarray):
        self.order = np.argsort(vocabulary)
        self.sorted = vocabulary[self.order]
        self.mass, self.depth = mass, (len(mass).bit_length() - 1) // DIGIT
        own = np.zeros(WIDTH**STEPS)
        own[WIDTH ** (STEPS - 1) :][: len(often)] = often
        self.logs = []
        for k in range(max(STEPS, 1 + self.depth)):
            # classes of step k: those of frequent words and, as class 0 of the first, those of all others
            n = own.reshape(WIDTH ** (k + 1), -1).sum(axis=1) if k < STEPS else np.zeros(WIDTH**k)
            if 0 < k <= self.depth:
                n[: WIDTH**k] += mass.reshape(WIDTH**k, -1).sum(axis=1)
            elif not k:
                n[0] += mass.sum()
            n = n.reshape(-1, WIDTH)
            with np.errstate(divide="ignore", invalid="ignore"):  # nothing leads to empty classes
                self.logs.append(np.log(n / n.sum(axis=1)[:, None]).astype(np.float32))

    def find(self, hashes: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(path, steps, leaf) of words; leaf is -1 for frequent ones. Words that are not known go to leaf 0."""
        item = np.full(len(hashes), -1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            item = np.where(self.sorted[at] == hashes, self.order[at], -1)
        leaf = (hashes >> np.uint64(64 - DIGIT * self.depth)).astype(np.int64)
        if known is not None:
            leaf[~known] = 0
        head = item >= 0
        return np.where(head, WIDTH ** (STEPS - 1) + item, leaf), np.where(head, STEPS, 1 + self.depth), np.where(head, -1, leaf)


class Model:
    """A table of weights, WIDTH a row; rows are hashed by feature and class."""

    def __init__(self, paths: Paths, table: np.ndarray):
        self.paths, self.w, self.size = paths, table, np.uint64(len(table))

    def steps(self, f: np.ndarray, path: np.ndarray, steps: np.ndarray):
        """For each step the positions that take it (None: all), their rows, what to predict, and where logits start."""
        least, most = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
        for k in range(most):
            which = None if k < least else np.flatnonzero(steps > k)
            own, left = (path, steps) if which is None else (path.take(which), steps.take(which))
            left = (left - k) * DIGIT
            node = own >> left
            used = f if k < DEEP else f[:1]
            mixed = (used if which is None else used.take(which, axis=1)) + (node + (1 << DIGIT * k)).view(np.uint64) * _K[2]
            mixed *= _K[3]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _K[1]
            mixed >>= np.uint64(32)
            mixed *= self.size
            mixed >>= np.uint64(32)
            left -= DIGIT
            yield which, mixed.view(np.int64), own >> left & WIDTH - 1, self.paths.logs[k].take(node, axis=0)

    def shares(self, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, and their sums. start is used up."""
        for r in rows:
            start += self.w.take(r, axis=0)
        np.clip(start, -80, 80, out=start)  # what float32 can hold; empty classes get next to nothing
        np.exp(start, out=start)
        return start, start @ np.ones(WIDTH, np.float32)

    def log_probabilities(self, f: np.ndarray, path: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of paths after their contexts."""
        out = np.zeros(len(path))
        for i in range(0, len(path), BATCH):
            part = out[i : i + BATCH]
            for which, rows, at, start in self.steps(f[:, i : i + BATCH], path[i : i + BATCH], steps[i : i + BATCH]):
                e, total = self.shares(rows, start)
                part[slice(None) if which is None else which] += np.log(e[np.arange(len(e)), at] / total)
        return out


class Learner:
    """Gradient steps with a rate for each weight (AdaGrad) over sparse rows."""

    def __init__(self, model: Model):
        self.m = model
        self.sq = _table(len(model.w))
        self.sq += np.float32(START_SQ)
        self.n = np.zeros(len(model.w), np.int32)
        self.last = np.zeros(len(model.w), np.int32)

    def learn(self, f: np.ndarray, path: np.ndarray, steps: np.ndarray) -> None:
        for i in range(0, len(path), BATCH):
            for _, rows, at, start in self.m.steps(f[:, i : i + BATCH], path[i : i + BATCH], steps[i : i + BATCH]):
                g, total = self.m.shares(rows, start)
                g *= (1 / total)[:, None]
                g[np.arange(len(g)), at] -= 1
                self._move(rows.ravel(), g)

    def _move(self, rows: np.ndarray, g: np.ndarray) -> None:
        """Each of rows, which are those of g once for each feature, gets the gradients of all its places."""
        position = np.tile(np.arange(len(g)), len(rows) // len(g))
        places = np.arange(len(rows), dtype=np.int32)
        self.last[rows] = places
        own = self.last.take(rows) == places
        at, more = np.flatnonzero(own), np.flatnonzero(~own)
        used, sums = rows.take(at), g.take(position.take(at), axis=0)
        if len(more):  # places of rows that stand again later
            self.last[used] = places[: len(used)]
            _add(sums, self.last.take(rows.take(more)), g.take(position.take(more), axis=0))
        np.add.at(self.n, rows, np.int32(1))
        w, sq = self.m.w, self.sq
        new = sq.take(used, axis=0)
        new += sums * sums
        _put(sq, used, new)
        sums *= RATE
        sums /= np.sqrt(new, out=new)
        np.subtract(w.take(used, axis=0), sums, out=sums)
        _put(w, used, sums)


def _add(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """np.add.at(table, at, rows), by pairs of numbers as complex ones: add.at is fast on flat arrays alone."""
    pairs = table.shape[1] // 2
    np.add.at(table.view(np.complex64).ravel(), (at[:, None] * np.int64(pairs) + np.arange(pairs)).ravel(), rows.view(np.complex64).ravel())


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, with a row as one item: much faster."""
    item = np.dtype((np.void, table.strides[0]))
    np.put(table.view(item).ravel(), at, np.ascontiguousarray(rows, table.dtype).view(item).ravel())


def _packed(table: np.ndarray, seen: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The rows that were updated, as half floats, and how often each was."""
    at = np.flatnonzero(seen)
    return tuple(zstandard.compress(x, 1) for x in (np.packbits(seen > 0).tobytes(), table[at].astype("<f2").tobytes(), seen[at].astype("<f4").tobytes()))


def _unpacked(rows: int, at: bytes, w: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, w, n = (zstandard.decompress(x) for x in (at, w, n))
    return np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8), count=rows)), np.frombuffer(w, "<f2").reshape(-1, WIDTH).astype(np.float32), np.frombuffer(n, "<f4")


def _table(rows: int) -> np.ndarray:
    """Zeros, no row of which lies in two cache lines."""
    room = np.zeros(rows * WIDTH + 16, np.float32)
    return room[-room.ctypes.data % 64 // 4 :][: rows * WIDTH].reshape(rows, WIDTH)


def whole(rows: int, packed: tuple[bytes, bytes, bytes] | None) -> np.ndarray:
    """A table of weights from what is sent of it."""
    table = _table(rows)
    if packed:
        at, w, _ = _unpacked(rows, *packed)
        table[at] = w
    return table


def _state(slot: int, table: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), *(pa.array([x], pa.binary()) for x in _packed(table, seen))], ["slot", "at", "w", "n"])


_STATE = "slot long, at binary, w binary, n binary"


def train(blocks: DataFrame, paths: Paths, rows: int, rounds: int = ROUNDS) -> tuple[bytes, bytes, bytes] | None:
    """Rounds of distributed gradient steps; what comes to the driver is one table, packed."""
    sc = blocks.sparkSession.sparkContext
    known = sc.broadcast(paths)
    most = max(sc.defaultParallelism, -(-blocks.count() // (TASK * rounds)))
    table, seen = np.zeros((rows, WIDTH), np.float32), np.zeros(rows, np.float32)
    for k in range(rounds):
        start = sc.broadcast(_packed(table, seen))

        def learn(batches, start=start):
            steady_heap()
            learner, slot = Learner(Model(known.value, whole(rows, start.value))), 0
            for batch in batches:
                for slot, lengths, flags, toks, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    b = Block(lengths, toks, hashes)
                    use = np.repeat(np.array(flags, bool), b.lengths)
                    own = b.flat[use]
                    path, steps, _ = known.value.find(b.hashes)
                    learner.learn(feature_hashes(*(x[use] for x in b.contexts())), path[own], steps[own])
            if learner.n.any():
                yield _state(slot, learner.m.w, learner.n)

        def add(batches):
            total, n_all, slot = np.zeros((rows, WIDTH), np.float32), np.zeros(rows, np.float32), 0
            for batch in batches:
                for slot, *sent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at, w, n = _unpacked(rows, *sent)
                    total[at] += w * n[:, None]
                    n_all[at] += n
            if n_all.any():
                total /= np.maximum(n_all, 1)[:, None]
                yield _state(slot, total, n_all)

        states = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds).cast("long")) == k).select(F.xxhash64("block").alias("slot"), "lengths", "train", "tokens", "hashes").coalesce(most).mapInArrow(learn, _STATE)
        width = -(-most // FAN_IN)
        while width > 1:  # a tree of sums: memory of one table a task
            states = states.repartition(F.pmod("slot", F.lit(width))).mapInArrow(add, _STATE)
            width = -(-width // FAN_IN)
        row = states.repartition(1).mapInArrow(add, _STATE).first()
        start.destroy()
        if row:
            at, w, n = _unpacked(rows, row["at"], row["w"], row["n"])
            table[at], seen[at] = w, seen[at] + n
    known.destroy()
    return _packed(table, seen)


_COUNTED = "block long, part int, c binary, types long, total long, top array<struct<h:long,c:long>>, depth int, first long, mass binary"


def _counted(blocks: DataFrame) -> DataFrame:
    """For each block and range of hashes a row with the corpus's counts of the block's words there, in ascending
    order of hashes; for each range a row without block: how many words and tokens training has there, its most
    frequent words, and the add-one counts by leaf of a tree that is deep enough for all words."""
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts, depth = max(1, -(-words // RANGE)), depth_of(words)

    def send(batches):
        for batch in batches:
            for block, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = np.frombuffer(hashes, np.uint64), _unplaned(counts)
                order = np.argsort(h)
                h, n = h[order], n[order]
                part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(np.full(len(edges) - 1, block, np.int64)), binaries(h, edges), binaries(n, edges)], ["part", "block", "h", "n"])

    schema = to_arrow_schema(T._parse_datatype_string(_COUNTED))

    def count(part: int, held: list):
        h = np.concatenate([x for _, x, _ in held])
        own, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, np.concatenate([x for _, _, x in held]), len(own)).astype("<i8")
        sent = [zstandard.compress(c[x].tobytes(), 1) for x in np.split(at, np.cumsum([len(x) for _, x, _ in held])[:-1])]
        leaf = (own >> np.uint64(64 - DIGIT * depth)).astype(np.int64)
        mass = np.bincount(leaf - leaf[0], np.where(c > 0, c + 1, 0)).astype("<i8")
        own = own.view(np.int64)
        top = np.lexsort((own, -c))[:HEAD]
        found = {"part": part, "types": int((c > 0).sum()), "total": int(c.sum()), "top": [{"h": int(own[k]), "c": int(c[k])} for k in top if c[k]], "depth": depth, "first": int(leaf[0]), "mass": zstandard.compress(mass.tobytes(), 1)}
        yield pa.RecordBatch.from_pylist([*({"block": b, "part": part, "c": x} for (b, _, _), x in zip(held, sent, strict=True)), found], schema)

    def add(batches):
        """Rows come sorted by range."""
        held, at = [], None
        for batch in batches:
            for part, block, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at and held:
                    yield from count(at, held)
                    held = []
                at = part
                held.append((block, np.frombuffer(h, np.uint64), np.frombuffer(n, "<i4")))
        if held:
            yield from count(at, held)

    sent = blocks.select("block", "hashes", "counts").mapInArrow(send, "part int, block long, h binary, n binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, _COUNTED)


def _paths(counted: DataFrame, words: int) -> Paths:
    """From the rows of ranges: at most HEAD words and the leaves' counts come to the driver."""
    ranges = counted.where("block is null")
    frequent = ranges.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("c"), "h").limit(HEAD).collect()
    vocabulary = np.array([r["h"] for r in frequent], np.int64).view(np.uint64)
    often = np.array([r["c"] + 1 for r in frequent], np.int64)
    depth = depth_of(words)
    mass = np.zeros(WIDTH**depth, np.int64)
    for r in ranges.select("depth", "first", "mass").toLocalIterator():
        own = np.frombuffer(zstandard.decompress(r["mass"]), "<i8")
        np.add.at(mass, r["first"] + np.arange(len(own)) >> DIGIT * (r["depth"] - depth), own)
    np.subtract.at(mass, (vocabulary >> np.uint64(64 - DIGIT * depth)).astype(np.int64), often)
    mass[0] += 1  # what training lacks
    return Paths(vocabulary, often, mass)


def lm_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    base_score is the add-one unigram log10 probability of the tokens, score the model's. Null and empty texts are
    the end token alone. Documents with crc32(doc_id) % modulus = held_out teach nothing; a null id teaches.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = store(own.mapInArrow(lambda batches: _pack(batches, modulus, held_out), _BLOCKS), "blocks")

    counted = store(_counted(blocks), "counted")
    total = counted.agg(F.sum("types"), F.sum("total")).first()
    v, n = total[0] or 0, total[1] or 0
    paths = _paths(counted, v)
    rows = table_rows(v)
    sent = spark.sparkContext.broadcast((paths, train(blocks, paths, rows, rounds)))

    def score(batches):
        steady_heap()
        m = Model(sent.value[0], whole(rows, sent.value[1]))
        for batch in batches:
            for ids, flags, lengths, toks, hashes, known in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                b = Block(lengths, toks, hashes)
                counts = np.empty(len(b.hashes), np.int64)
                counts[np.argsort(b.hashes)] = np.frombuffer(b"".join(zstandard.decompress(k["c"]) for k in known), "<i8")
                base = np.log10((counts + 1) / (n + v + 1))
                path, steps, leaf = m.paths.find(b.hashes, counts > 0)
                share = np.where(leaf < 0, 0.0, np.log10((counts + 1) / np.maximum(m.paths.mass[leaf], 1)))
                logs = m.log_probabilities(feature_hashes(*b.contexts()), path[b.flat], steps[b.flat]) / np.log(10) + share[b.flat]
                total = lambda x, s=b.starts: np.add.reduceat(x, s)
                cols = [pa.array(ids, pa.int64()), pa.array([not x for x in flags]), pa.array(b.lengths), pa.array(total((counts > 0)[b.flat].astype(np.int64))), pa.array(np.full(len(ids), n, np.int64)), pa.array(total(base[b.flat])), pa.array(total(logs))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    known = counted.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("known"))
    joined = blocks.join(known, "block").select("doc_ids", "train", "lengths", "tokens", "hashes", "known")
    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
