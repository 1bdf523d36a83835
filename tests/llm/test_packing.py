import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import packing
from colloquy.llm.queries import QUERIES
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check_places(rows, capacity):
    """Pieces cover their documents, and sequences have neither gaps nor overlaps. The number of sequences."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


PIECES = ["Hello", " world", "É", "é", "\U0001f600", "日本", "don't", "'s", "'S", "1234", " 12", "<|endoftext|>", "<|end", " ", "  ", "\n", " \n", "\t", " ", " ", "\x00", "ſ", "---", "a" * 50, "͸", "Ᲊ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_ids_equal_the_librarys(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    with open(PATH, encoding="utf-8") as f:
        ours = packing.keep("test", "bytes", lambda: packing.ByteBPE(f.read()))
    assert ours.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def best(lengths, capacity):
    """The fewest bins, by trying everything."""
    for k in range(1, len(lengths) + 1):
        def fits(i, room):
            if i == len(lengths):
                return True
            return any(room[j] >= lengths[i] and fits(i + 1, room[:j] + (room[j] - lengths[i],) + room[j + 1 :]) for j in range(k) if room.index(room[j]) == j)

        if fits(0, (capacity,) * k):
            return k
    return 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_plans_are_as_good_as_the_best(lengths):
    lengths = sorted(lengths, reverse=True)
    patterns = packing.plan(dict(Counter(lengths)), 20)
    used = Counter(n for p, m in patterns for n in p for _ in range(m))
    assert used == Counter(lengths) and all(sum(p) <= 20 for p, _ in patterns)
    assert sum(m for _, m in patterns) <= best(lengths, 20) + (len(lengths) > 8)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 40), st.lists(st.integers(1, 15), max_size=8))
def test_completions_waste_least(room, items):
    counts = Counter(items)
    found = packing.completions(room, dict(counts), sorted(counts))
    sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
    assert room - sum(found[0]) == room - max(s for s in sums if s <= room)
    assert not Counter(found[0]) - counts


def fillings(room, items):
    """All that fit, as sorted tuples."""
    return {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 15), min_size=1, max_size=8))
def test_fillings_that_others_dominate_are_never_kept(room, items):
    counts = Counter(items)
    found = packing.completions(room, dict(counts), sorted(counts), want=100)
    every = fillings(room, items)

    def beaten(f):
        rest = counts - Counter(f)
        own = [Counter()] + [Counter(c) for k in (1, 2) for c in itertools.combinations(f, k)]  # nothing, one or two of its items
        return any(x > s.total() if not s else x >= sum(s.elements()) and s != Counter([x]) and x - sum(s.elements()) <= room - sum(f) for s in own for x in rest if s or x <= room - sum(f))

    assert found and set(found) <= every and len(set(found)) == len(found)
    assert set(found) == {f for f in every if not beaten(f)}


def test_an_example_of_dominance():
    assert packing.completions(16, {5: 3, 7: 1, 4: 1}, [4, 5, 7], want=10) == [(7, 5, 4), (5, 5, 5)]


def test_large_plans_waste_little():
    rng = random.Random(1)
    histogram = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(50_000))
    patterns = packing.plan(dict(histogram))
    used = Counter()
    for p, m in patterns:
        for n in p:
            used[n] += m
    total = sum(n * c for n, c in histogram.items())
    assert used == histogram and sum(m for _, m in patterns) <= 1.001 * total / 2048 + 2
    assert packing.plan({}) == [] and packing.plan({5: 1_000_003}, 20) == [((5, 5, 5, 5), 250_000), ((5, 5, 5), 1)]


def test_the_search_goes_back_with_many_lengths():
    rng, items = random.Random(1), []
    while len(items) < 900:  # 300 sequences suffice
        a, b = rng.randint(400, 1000), rng.randint(400, 1000)
        items += [a, b, 2048 - a - b] if 400 <= 2048 - a - b <= 1000 else []
    histogram = Counter(items)
    patterns = packing.plan(dict(histogram))
    used = Counter(n for p, m in patterns for n in p for _ in range(m))
    assert len(histogram) > 400 and used == histogram and all(sum(p) <= 2048 for p, _ in patterns)
    assert sum(m for _, m in patterns) <= 306


def test_documents_are_cut_and_placed(spark, library):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, "a", 9, "x"), (1, "a", 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (4, long, 9, "x"), (None, "null id", 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")
    out = packing.best_fit_packing(df, PATH, with_ids=True).collect()
    check_places(out, 2048)
    cut = sorted((r for r in out if r["doc_id"] == 4), key=lambda r: r["piece"])
    want = [*library.encode(long, add_special_tokens=False).ids, 0]
    assert [x for r in cut for x in r["ids"]] == want and [r["length"] for r in cut][1:] == [2048] * (len(cut) - 1)
    assert [r["start"] for r in cut] == [sum(x["length"] for x in cut[:i]) for i in range(len(cut))]
    assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) for r in out)
    assert sum(r["doc_id"] == 1 for r in out) == 2 and [r["ids"] for r in out if r["doc_id"] in (2, 3)] == [[0], [0]]
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_one_length_in_many_rows(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'same' as text")
    out = packing.pack(packing.pieces(df, PATH, capacity=16), 16, bucket_rows=300).collect()
    n = out[0]["length"]
    assert len(out) == 5000 and check_places(out, 16) == -(-5000 // (16 // n))
    full = packing.pack(packing.pieces(df, PATH, capacity=n), n).collect()
    assert len(full) == check_places(full, n) == 5000


def test_query_packs_documents_tightly(spark, library):
    sf = f"{DATA}/sf0.001"
    out = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    total = 0
    for d in docs:
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cut = sorted(by_doc.pop(d["doc_id"]), key=lambda r: r["piece"])
        assert [r["piece"] for r in cut] == list(range(len(cut))) and sum(r["length"] for r in cut) == len(ids) and (len(cut) == 1) == (len(ids) <= 2048)
        for r in cut:
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
    assert not by_doc and check_places(out, 2048) <= -(-total // 2048) + 1
