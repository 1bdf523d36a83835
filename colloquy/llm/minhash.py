"""Near-duplicate groups by circulant MinHash, banding and exact verification.

A text is the set of its word shingles. Shingles are mapped into a space of DIM slots; one fixed permutation
shuffles the slots, a second one, circularly shifted by k, gives the k-th signature coordinate: the minimum over
the text's slots. Two permutations thus serve for all coordinates, and the coordinates of one slot are one
contiguous stretch of the second. Coordinates are banded; texts that share a band are candidates, and candidates
are linked only after comparing their full sets.

Texts with the same set are one class from the start. Among class representatives no bucket is expanded into rows
of pairs: in each bucket the members are compared with one hub, confirmed links merge components, and buckets that
lie in one component are done. Crowded buckets meet further hubs as long as these link. What is left are buckets of texts that are
alike, but mostly not enough; there the sets themselves are compared in blocks of bounded size, and each block gives
no more links than it has members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import bloom
from colloquy.llm.common import column_udf, keep, store
from colloquy.llm.components import link

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 64, 8  # a pair of similarity 0.8 shares no band with probability 8e-6
DIM = 1 << 20
#: How many hubs each text is compared with in each round; rounds end when they link few of the texts left.
HUBS = (1, 4, 8, 8, 8, 8, 8, 8)
FEW = 0.01
#: Members and bytes of sets in one block of a bucket, about.
BLOCK, BLOCK_BYTES = 500, 8 << 20
COLUMNS = 4096  # shingles that blocks are compared on at a time
CACHE = 150_000

_FACTORS = np.random.default_rng(11).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of size words; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    held = keep("minhash", "words", _Held).words
    if len(held) > CACHE:
        held.clear()
    w = np.fromiter(map(held.__getitem__, words), np.uint64, n)
    k = min(n, size)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h) + w[i : n - k + 1 + i] * _FACTORS[i % 64]
    return np.unique(_mix(h))


class Circulant:
    def __init__(self, coordinates: int, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.k = dim, coordinates
        self.first = rng.permutation(dim).astype(np.int32)
        second = rng.permutation(dim).astype(np.int32)
        reach = np.concatenate([second, second[: coordinates - 1]]) if coordinates <= dim else np.resize(second, dim + coordinates)
        self.shifted = np.lib.stride_tricks.sliding_window_view(reach, coordinates)

    def signature(self, h: np.ndarray) -> np.ndarray:
        out = np.full(self.k, self.dim, np.int32)
        slots = self.first[(h & np.uint64(self.dim - 1)).astype(np.int64)]
        for i in range(0, len(slots), 256):
            np.minimum(out, self.shifted[slots[i : i + 256]].min(axis=0), out=out)
        return out


class _Held:
    def __init__(self):
        self.words, self.circulant = _Words(), {}


def band_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    made = keep("minhash", "words", _Held).circulant
    c = made.get(bands * rows) or made.setdefault(bands * rows, Circulant(bands * rows))
    s = c.signature(h).astype(np.uint64).reshape(bands, rows)
    return _mix((s * _FACTORS[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb) whose full sets are similar."""

    def inter(x, y):
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            out.append(int((q[at] == p).sum()))
        return out

    near = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))  # else they can't be
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = near.join(a, "a").join(b, "b").withColumn("same", column_udf(inter, "long")(F.col("sa"), F.col("sb")))
    return both.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Texts are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links reach. Texts without words are linked with nothing. Rows with the same doc_id are
    one document with several texts; a null doc_id is never linked and has a null component.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def sketch(texts):
        out = []
        for t in texts:
            h = shingles(t, shingle)
            out.append({"n": len(h), "digest": hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None, "bands": band_hashes(h, bands, rows).tolist() if len(h) else []})
        return out

    sketched = store(own.select("doc_id", column_udf(sketch, "struct<n:long,digest:binary,bands:array<long>>")(F.col("text")).alias("s")).select("doc_id", "s.*"), "sketches")
    known = sketched.where("digest is not null and doc_id is not null")
    classes = store(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    # one row a class: a group of copies, however large, is dealt by digest and doc_id together
    reps = known.join(classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "digest", "bands").dropDuplicates(["node", "digest"])
    banded = reps.select("node", "n", F.explode("bands").alias("band"))
    shared = store(banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("band"), "shared")
    members = store(banded.join(shared, "band"), "members")  # band, node, n
    nodes = store(members.select("node").distinct(), "nodes")
    # only texts that share a band are read again for their sets: a filter of ids leaves few others
    likely = bloom.sent(nodes, nodes.count())

    def bytes_of(ids, texts):
        return [shingles(t, shingle).tobytes() if hit else None for t, hit in zip(texts, likely(ids), strict=True)]

    sets = own.select(F.col("doc_id").alias("node"), column_udf(bytes_of, "binary")(F.col("doc_id"), F.col("text")).alias("set"))
    sets = store(sets.where("set is not null").join(nodes, "node"), "sets")

    labels = nodes.select("node", F.col("node").alias("label"))
    for k, most in enumerate(HUBS):
        # after the first hub, buckets that fit in one block are left to it
        met = members if k == 0 else store(_crowded(members), "crowded")
        pairs = store(_to_hubs(met, labels, k, most, percent), "pairs")
        links = store(_similar(pairs, sets, percent), "links")
        n_links = links.count()
        if n_links:
            labels = link(labels, links)
            members = store(_unsettled(members, labels), "members")
        if n_links <= FEW * met.select("node").distinct().count():
            break
    labels = link(labels, store(_in_blocks(members, labels, sets, percent), "links"))

    found = classes.join(labels.withColumnRenamed("node", "doc_id"), classes["node"] == F.col("doc_id"), "left").select("digest", F.coalesce("label", "node").alias("component"))
    out = sketched.select("doc_id", "n", "digest").join(store(found, "found"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _to_hubs(members: DataFrame, labels: DataFrame, k: int, most: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of texts with hubs of their buckets that are in other components: for each text the
    `most` hubs that it shares most buckets with. A bucket's hub is its smallest member, in later rounds a
    pseudo-random one."""
    rank = F.col("node") if k == 0 else F.xxhash64("node", F.lit(k))
    hubs = members.groupBy("band").agg(F.min(F.struct(rank.alias("r"), "node", "n")).alias("hub")).select("band", F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"))
    hubs = store(hubs.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"), "hubs")
    met = members.join(labels, "node").join(hubs, "band").where("label <> lb").where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    met = met.groupBy("node", "n", "b", "nb").agg(F.count(F.lit(1)).alias("c"))
    # a text has as many hubs as bands at most
    best = met.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.xxhash64("b", F.lit(k)).alias("r"), "b", "nb"))).alias("hubs"))
    return best.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.slice("hubs", 1, most)).alias("h")).select("a", "h.b", "na", "h.nb")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members of the buckets that lie in several components."""
    mixed = members.join(labels, "node").groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    return members.join(mixed, "band")


def _crowded(members: DataFrame) -> DataFrame:
    """members of the buckets that have more than one block."""
    return members.join(members.groupBy("band").count().where(F.col("count") > BLOCK).select("band"), "band")


def block_links(ids: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block: pairs of similar sets, a spanning forest of them. Sets of sides 0
    and 1 are compared across, those of side 0 alone among themselves."""
    roots = {x: x for x in labels}

    def root(x):
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared) - 1
    owner, hit = np.repeat(np.arange(len(sets)), sizes), shared[at]
    owner, at = owner[hit], column[at[hit]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    same = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        same += (m @ m.T).astype(np.int64)  # exact: a chunk has fewer columns than float32 has integers
    near = 100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)
    own, side = np.array(labels), np.array(sides)
    near &= own[:, None] != own[None, :]
    near &= side[:, None] < side[None, :] if side.any() else np.triu(np.ones_like(near), 1)
    out = []
    for x, y in zip(*np.nonzero(near), strict=True):
        p, q = root(labels[x]), root(labels[y])
        if p != q:
            roots[p] = q
            out.append((ids[x], ids[y]))
    return out


def _in_blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components in each bucket. A bucket's members are dealt into blocks by hash, as many
    as its size needs, and every pair of blocks is one group of bounded size."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("long")
    dealt = members.join(members.groupBy("band").agg(parts.alias("parts")), "band").join(labels, "node").join(sets, "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    groups = dealt.groupBy("band", lo.alias("lo"), hi.alias("hi")).agg(F.collect_list(F.struct("node", "label", (F.col("own") != lo).cast("int").alias("side"), "set")).alias("block"))

    def found(blocks):
        out = []
        for b in blocks:
            b = sorted(b, key=lambda r: r["node"])
            if len({r["label"] for r in b}) < 2:
                out.append([])
                continue
            links = block_links([r["node"] for r in b], [r["label"] for r in b], [r["side"] for r in b], [np.frombuffer(r["set"], np.uint64) for r in b], percent)
            out.append([{"a": a, "b": b} for a, b in links])
        return out

    # two blocks of which one is empty have nothing to compare
    groups = groups.where((F.col("lo") == F.col("hi")) | (F.exists("block", lambda r: r["side"] == 0) & F.exists("block", lambda r: r["side"] == 1)))
    return groups.select(F.explode(column_udf(found, "array<struct<a:long,b:long>>")(F.col("block"))).alias("l")).select("l.a", "l.b").distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; all columns stay.

    Rows of one doc_id are one document, of which one row stays, whichever. Rows without doc_id come after all others,
    those of equal text being one document. Rows without words stay all.
    """
    own = docs.columns
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn("_key", F.coalesce(F.col(doc_id).cast("long"), nameless)).withColumn("_worded", worded)
    found = near_duplicates(keyed, "_key", text, **options)
    gone = store(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    again = store(keyed.where("_worded").groupBy("_key").count().where("count > 1").select(F.col("_key").alias("_gone")), "again")
    some = gone.unionByName(again)
    flagged = keyed.withColumn("_maybe", bloom.possibly(keyed, "_key", some, gone.count() + again.count()) & F.col("_worded"))
    # only rows that may have to go are dealt out by id
    stay = flagged.where("not _maybe").select(*own)
    met = flagged.where("_maybe").join(gone, F.col("_key") == F.col("_gone"), "left_anti").dropDuplicates(["_key"])
    return stay.unionByName(met.select(*own))
