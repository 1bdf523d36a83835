import random

import numpy as np
import pytest

from colloquy.llm import bloom, components, minhash
from colloquy.llm.queries import QUERIES
from tests.conftest import DATA, rows

SCHEMA = "doc_id long, text string"


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=5, groups=12, copies=14):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyz")
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((1, 3, 30, 120)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own).upper() if rng.random() < 0.3 else "  ".join(own))
    docs += ["", None, " \n", "one", "one"]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize(("block", "hubs"), [(500, 8), (3, 1), (3, 8)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, block, hubs):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "HUBS", minhash.HUBS[:hubs])
    docs = corpus()
    want = brute(docs, 4)
    got = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), shingle=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)
    assert len({c for _, c in want.values()}) < len(docs) - 20


def test_query_equals_brute_force_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op2_minhash"](spark, f"{DATA}/sf0.001").collect()}
    assert got == brute(docs, 4)


def test_block_links_join_what_all_pairs_would():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 60, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(40)]
    ids = list(range(40))
    near = [(i, j) for i in ids for j in ids[:i] if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]

    def parts(links, count):
        root = list(range(count))
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    links = minhash.block_links(ids, ids, [0] * 40, sets, 80)
    assert parts(links, 40) == parts(near, 40) and len(links) < 40 and 0 < len(near)
    side = [i % 2 for i in ids]
    links = minhash.block_links(ids, ids, side, sets, 80)
    assert parts(links, 40) == parts([(i, j) for i, j in near if side[i] != side[j]], 40)
    assert minhash.block_links(ids, [7] * 40, [0] * 40, sets, 80) == []


def test_circulant_signature_is_two_permutations():
    c = minhash.Circulant(16, dim=64)
    h = np.array([3, 64 + 9, 40], np.uint64)
    slots = [int(c.first[int(x) % 64]) for x in h]
    second = [int(c.shifted[i, 0]) for i in range(64)]
    assert c.signature(h).tolist() == [min(second[(s + k) % 64] for s in slots) for k in range(16)]


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " more"), (8, None)], SCHEMA)
    got = rows(minhash.near_duplicates(near).select("doc_id", "component_id", "kept"))
    assert got == [(None, None, None), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    wide = spark.createDataFrame([(5, text, 1, "k"), (7, text, 2, "l"), (None, text, 3, "m")], SCHEMA + ", node int, kept string")
    kept = minhash.keep_one(wide)
    assert kept.columns == wide.columns and [r["node"] for r in kept.collect()] == [1]  # a row without id is a copy like others
    assert minhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_compared_whole(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:50_000] + ["x"] * 10_000)), (3, " ".join(words[:40_000] + [f"y{i}" for i in range(20_000)]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows_in = [(7, a, 1), (7, a, 2), (3, a + " more", 3), (None, a, 4), (None, b, 5), (None, b, 6), (9, None, 7), (9, " ", 8), (None, None, 9), (None, "", 10), (11, "c d", 11), (11, "e f", 12)]
    got = minhash.keep_one(spark.createDataFrame(rows_in, SCHEMA + ", component_id int")).collect()
    kept = sorted(r["component_id"] for r in got)
    assert [x for x in kept if x <= 4] == [3] and len([x for x in kept if x in (5, 6)]) == 1 and [x for x in kept if 7 <= x <= 10] == [7, 8, 9, 10]
    assert len([x for x in kept if x > 10]) == 1 and got[0].asDict().keys() == {"doc_id", "text", "component_id"}


def test_links_along_a_chain(spark):
    labels = spark.createDataFrame([(i, i) for i in range(50)], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 49) if i != 30], "a long, b long")
    assert rows(components.link(labels, edges)) == rows(spark.createDataFrame([(i, 0 if i <= 30 else 31) for i in range(50)], "node long, label long"))


def test_bloom_filter_has_all_its_keys(spark):
    ids = spark.range(1000)
    hit = bloom.sent(ids, 1000)
    assert hit(list(range(1000))).all() and hit(list(range(5000, 9000))).mean() < 0.1
    pair = bloom.Pair(bloom.bits_for(10))
    pair.add(bloom.hash_ids(["a", "b"]), np.array([False, False]))
    pair.add(bloom.hash_ids(["a", "c", "d"]), np.array([False, False, True]))
    assert pair.twice_seen(bloom.hash_ids(["a", "b", "c", "d"])).tolist() == [True, False, False, True]
