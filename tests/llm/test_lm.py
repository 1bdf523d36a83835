import math
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from colloquy.llm import maxent_lm as lm
from colloquy.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def brute_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base score)}"""
    counts, total = Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(lm.tokens(t))
    total = sum(counts.values())
    out = {}
    for i, t in docs:
        own = lm.tokens(t)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op7_maxent_lm"](spark, f"{DATA}/sf0.01").collect()


def test_base_scores_equal_brute_force(spark, scored):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    want = brute_base(docs)
    assert len(scored) == len(docs)
    for r in scored:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_model_beats_the_base_on_held_out_documents(scored):
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 50
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.02 * sum(r["n_tokens"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored)


def some_paths(n, words=20_000):
    """Paths of n frequent words and of words known by their hashes alone."""
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, 9, len(hashes))
    mass = np.bincount((hashes[n:] >> np.uint64(64 - lm.DIGIT * lm.depth_of(words))).astype(int), counts[n:] + 1, lm.WIDTH ** lm.depth_of(words)).astype(np.int64)
    mass[0] += 1
    return lm.Paths(hashes[:n], counts[:n] + 1, mass), hashes, counts


@pytest.mark.parametrize("n", [0, 5, lm.HEAD])
def test_probabilities_of_all_words_sum_to_one(n):
    paths, hashes, counts = some_paths(n)
    table = np.random.default_rng(1).standard_normal((1 << 14, lm.WIDTH)).astype(np.float32)
    for model in (lm.Model(paths, table), lm.Model(paths, np.zeros_like(table))):
        path, steps, leaf = paths.find(hashes)
        f = lm.feature_hashes(np.full(len(hashes), 77, np.uint64), np.full(len(hashes), 99, np.uint64))
        share = np.where(leaf < 0, 1, (counts + 1) / paths.mass[leaf])
        p = np.exp(model.log_probabilities(f, path, steps)) * share
        other, few, _ = paths.find(np.array([1], np.uint64), np.array([False]))  # a word that training lacks
        assert other.tolist() == [0] and p.sum() + np.exp(model.log_probabilities(f[:, :1], other, few))[0] / paths.mass[0] == pytest.approx(1, abs=1e-4)
    assert np.allclose(p, (counts + 1) / (counts.sum() + len(counts) + 1), rtol=1e-4)  # untrained it is the unigram


def test_scores_equal_those_of_a_slow_program():
    """One text's log probability, token by token and class by class, from a table of random weights."""
    paths, hashes, counts = some_paths(300)
    table = np.random.default_rng(5).standard_normal((999, lm.WIDTH)).astype(np.float32)
    model = lm.Model(paths, table)
    words = np.random.default_rng(6).integers(0, 2000, 60)
    b = lm.Block([60], lm._planes(np.arange(60)), hashes[words].tobytes())
    path, steps, leaf = paths.find(b.hashes)
    got = model.log_probabilities(lm.feature_hashes(*b.contexts()), path, steps)
    k, mask = [int(x) for x in lm._K], (1 << 64) - 1
    for i in range(60):
        one, two = (int(b.hashes[i - n]) if i >= n else int(lm._START) for n in (1, 2))
        features = [(one * k[0] & mask) ^ k[4], ((one * k[1] + two * k[2]) & mask) ^ k[5], (two * k[3] & mask) ^ k[6]]
        total, prefix = 0.0, 0
        for step in range(int(steps[i])):
            digit = int(path[i]) >> lm.DIGIT * (int(steps[i]) - step - 1) & lm.WIDTH - 1
            z = paths.logs[step][prefix].astype(float)
            for f in features if step < lm.DEEP else features[:1]:
                x = (f + (prefix + (1 << lm.DIGIT * step)) * k[2]) * k[3] & mask
                x ^= x >> 29
                z = z + table[((x * k[1] & mask) >> 32) * 999 >> 32]
            total += z[digit] - np.log(np.exp(z).sum())
            prefix = prefix * lm.WIDTH + digit
        assert got[i] == pytest.approx(total, abs=1e-3)


def test_contexts_stop_at_documents():
    hashes = np.array([10, 20, 30], np.uint64)
    b = lm.Block([1, 3, 2], lm._planes(np.array([0, 1, 2, 0, 2, 1])), hashes.tobytes())
    one, two = b.contexts()
    s = lm._START
    assert one.tolist() == [s, s, 20, 30, s, 30] and two.tolist() == [s, s, s, 20, s, s]


def test_learning_lowers_the_loss():
    paths, _, _ = some_paths(lm.HEAD)
    word = np.random.default_rng(2).integers(1, 5, 4000)
    path = lm.WIDTH ** (lm.STEPS - 1) + word * 701  # the word before says it all
    f = lm.feature_hashes(word.astype(np.uint64), np.zeros(4000, np.uint64))
    learner = lm.Learner(lm.Model(paths, np.zeros((1 << 14, lm.WIDTH), np.float32)))
    for _ in range(60):
        learner.learn(f, path, np.full(4000, lm.STEPS))
    assert learner.m.log_probabilities(f, path, np.full(4000, lm.STEPS)).mean() > -0.7


def test_rows_move_by_the_sum_of_their_gradients():
    paths, _, _ = some_paths(5)
    rng = np.random.default_rng(4)
    learner = lm.Learner(lm.Model(paths, rng.standard_normal((50, lm.WIDTH)).astype(np.float32)))
    before, g, rows = learner.m.w.copy(), rng.standard_normal((40, lm.WIDTH)).astype(np.float32), rng.integers(0, 50, (3, 40))
    want = np.zeros((50, lm.WIDTH))
    for r in rows:
        np.add.at(want, r, g)
    learner._move(rows.ravel(), g)
    assert np.allclose(learner.m.w, before - lm.RATE * want / np.sqrt(lm.START_SQ + want**2), atol=1e-5)
    assert learner.n.tolist() == np.bincount(rows.ravel(), minlength=50).tolist()


def batches(docs, rows):
    return pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}).to_batches(max_chunksize=rows)


@pytest.fixture
def task(monkeypatch):
    """As if in partition 3."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))


def test_blocks_hold_the_tokens_of_every_text(task, monkeypatch):
    odd = [None, "", " ", "\n\n", " a  B\tc\x0bD\x0ce\r\nF ", "ÀÉ àé İ ẞ\x1cx\x85y\xa0z\u2003w", "\x00 \x00a", "A a", "日本 語\U0001f600", "word " * 50]
    docs = [(i if i % 5 else None, odd[i % len(odd)]) for i in range(60)]
    for block, batch in ((8_000_000, 7), (40, 7), (1, 60), (300, 1)):
        monkeypatch.setattr(lm, "BLOCK", block)
        rows, at = [r for b in lm._pack(batches(docs, batch), 7, 2) for r in b.to_pylist()], 0
        assert [r["block"] for r in rows] == [3 << 32 | k for k in range(len(rows))] and (len(rows) > 1) == (block < 8_000_000)
        for r in rows:
            own = docs[at : at + len(r["doc_ids"])]
            at += len(own)
            want = [lm.tokens(t) for _, t in own]
            flat, hashes, flags = lm._unplaned(r["tokens"]), np.frombuffer(r["hashes"], np.uint64), [lm.in_training(i, 7, 2) for i, _ in own]
            assert (r["doc_ids"], r["train"], r["lengths"], r["n_words"]) == ([i for i, _ in own], flags, [len(w) for w in want], len(hashes))
            assert hashes[flat].tolist() == [xxhash.xxh3_64_intdigest(x) for w in want for x in w]
            count = Counter(xxhash.xxh3_64_intdigest(x) for w, learn in zip(want, flags, strict=True) if learn for x in w)
            assert lm._unplaned(r["counts"]).tolist() == [count[h] for h in hashes.tolist()]
        assert at == len(docs)


def test_blocks_take_less_time_than_numbering_words_one_by_one(task):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{n}" for n in rng.zipf(1.2, 2000) % 100_000)) for i in range(150)]
    sent, took = batches(docs, 50), {"pack": [], "one by one": []}

    def one_by_one():
        known = {}
        return [np.array([known.setdefault(w, len(known)) for w in lm.tokens(t)], np.int32) for _, t in docs]

    for _ in range(7):
        for name, run in (("pack", lambda: list(lm._pack(sent, 7, 2))), ("one by one", one_by_one)):
            start = time.process_time_ns()
            run()
            took[name].append(time.process_time_ns() - start)
    assert min(took["pack"]) < 0.9 * min(took["one by one"])


def columns_added(rows, g, sums, seen):
    """Gradients and visits by row, one column after the other."""
    at = rows.ravel()
    for c, column in enumerate(np.tile(g, (len(rows), 1)).T.astype(np.float64)):
        sums[:, c] = np.bincount(at, column, len(sums))
    seen[:] = np.bincount(at, minlength=len(sums))


def test_rows_that_repeat_move_in_less_time_than_columns_are_added_in():
    paths, _, _ = some_paths(5)
    rng = np.random.default_rng(8)
    g, rows = rng.standard_normal((lm.BATCH, lm.WIDTH)).astype(np.float32), rng.integers(0, 3000, (lm.FEATURES, lm.BATCH))
    learner = lm.Learner(lm.Model(paths, np.zeros((3000, lm.WIDTH), np.float32)))
    sums, seen = np.zeros((3000, lm.WIDTH)), np.zeros(3000)
    took = {"move": [], "columns": []}
    for _ in range(15):
        for name, run in (("move", lambda: learner._move(rows.ravel(), g)), ("columns", lambda: columns_added(rows, g, sums, seen))):
            start = time.process_time_ns()
            run()
            took[name].append(time.process_time_ns() - start)
    assert min(took["move"]) < 0.85 * min(took["columns"])
    assert learner.n.tolist() == (15 * seen).tolist()
    first = lm.Learner(lm.Model(paths, np.zeros((3000, lm.WIDTH), np.float32)))
    first._move(rows.ravel(), g)
    assert np.allclose(first.m.w, -lm.RATE * sums / np.sqrt(lm.START_SQ + sums**2), atol=1e-5)


def test_visits_of_a_row_are_counted_beyond_what_float32_tells_apart():
    paths, _, _ = some_paths(5)
    learner = lm.Learner(lm.Model(paths, np.zeros((50, lm.WIDTH), np.float32)))
    learner.n[7] = 1 << 24
    for _ in range(4):
        learner._move(np.full(1, 7), np.ones((1, lm.WIDTH), np.float32))
    assert int(learner.n[7]) == (1 << 24) + 4


def test_positions_are_listed_only_where_some_words_take_no_further_step():
    paths, hashes, _ = some_paths(300)
    model = lm.Model(paths, np.zeros((999, lm.WIDTH), np.float32))
    path, steps, _ = paths.find(hashes)
    f = lm.feature_hashes(hashes, hashes[::-1])
    listed = [which for which, *_ in model.steps(f, path, steps)]
    assert len(listed) == steps.max() and all((which is None) == (steps > k).all() for k, which in enumerate(listed))
    assert all((which == np.flatnonzero(steps > k)).all() for k, which in enumerate(listed) if which is not None)


def test_no_row_of_learned_tables_lies_in_two_cache_lines():
    paths, _, _ = some_paths(5)
    for rows in (1000, lm.table_rows(0), lm.table_rows(4_000_000)):
        model = lm.Model(paths, lm.whole(rows, None))
        learner = lm.Learner(model)
        for table, start in ((model.w, 0), (learner.sq, lm.START_SQ)):
            assert table.shape == (rows, lm.WIDTH) and table.dtype == np.float32 and table.flags.c_contiguous
            assert table.ctypes.data % 64 == 0 and (table == start).all()


def test_states_keep_what_was_updated():
    w, n = np.arange(80, dtype=np.float32).reshape(10, 8), np.array([0, 2, 0, 1, 0, 0, 0, 0, 0, 5], np.float32)
    row = lm._state(3, w, n).to_pylist()[0]
    at, got, seen = lm._unpacked(10, row["at"], row["w"], row["n"])
    assert at.tolist() == [1, 3, 9] and (got == w[at]).all() and seen.tolist() == [2, 1, 5]


def test_order_of_words_matters_and_blocks_do_not(spark, monkeypatch):
    docs = [(i, "the cat sat on the mat") for i in range(300)]
    asked = [(1000, "the cat sat on the mat"), (1001, "mat the on sat cat the")]
    got = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(docs + asked, SCHEMA)).collect()}
    assert got[1000]["score"] > got[1001]["score"] + 1 and got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    monkeypatch.setattr(lm, "BLOCK", 50)
    cut = {r["doc_id"]: r for r in lm.lm_scores(spark.createDataFrame(docs + asked, SCHEMA)).collect()}
    assert all(cut[i]["base_score"] == pytest.approx(got[i]["base_score"]) and cut[i]["n_known"] == got[i]["n_known"] for i in got)


def test_nulls_repeats_long_texts_empty_tables_and_other_columns(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1), (2, "", 1), (3, "A a", 1), (3, "A a", 1), (None, "a", 1), (4, "w " * 300_000, 1)]
    out = lm.lm_scores(spark.createDataFrame(rows, SCHEMA + ", score int"))
    got = out.collect()
    assert len(got) == 6 and out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and by[3]["n_tokens"] == 3 and by[4]["n_tokens"] == 300_001 and by[None]["held_out"] is False
    only = [r for r in range(100) if zlib.crc32(str(r).encode()) % 7 == 2][:2]  # nothing to learn from
    alone = lm.lm_scores(spark.createDataFrame([(i, "x") for i in only], SCHEMA)).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"]) for r in alone] == [(0, 0, 0.0)] * 2


def test_rare_words_are_predicted_from_their_contexts(spark):
    common = " ".join(f"common{i}" for i in range(lm.HEAD))
    pairs = " ".join(f"left{i} right{i}" for i in range(60))
    docs = [(i, common) for i in range(60)] + [(100 + i, pairs) for i in range(40)]  # the pairs have no paths of their own
    asked = [(1000 + i, f"left{i} right{i}") for i in range(1, 21)] + [(2000 + i, f"left{i} right{i + 20}") for i in range(1, 21)]
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(docs + asked, SCHEMA)).collect()}
    assert sum(got[1000 + i] - got[2000 + i] for i in range(1, 21)) > 20 * 0.3


def test_classes_and_table_grow_with_the_words():
    assert [lm.depth_of(n) for n in (0, 8, 80_000, 400_000, 10**9)] == [1, 1, 5, 6, 7]
    assert lm.table_rows(4_000_000) > lm.table_rows(400_000) > lm.table_rows(4000) == 1 << 16
