import zlib

import numpy as np
import pytest

from colloquy.llm import labels, quality_classifier, toxicity
from colloquy.llm.queries import QUERIES
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def area(pairs):
    """How often a row of label 1 scores above one of label 0."""
    ones, zeros = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


@pytest.mark.parametrize(("query", "label", "modulus", "remainder"), [("op4_subword_quality", "quality", 4, 2), ("op6_ftrl_toxicity", "toxic", 3, 1)])
def test_held_out_labels_are_predicted(spark, query, label, modulus, remainder):
    sf = f"{DATA}/sf0.1"
    out = QUERIES[query](spark, sf)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    known = [(got[r["doc_id"]]["score"], r[label]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and r[label] is not None and got[r["doc_id"]]["held_out"]]
    assert {y for _, y in known} == {0, 1} and area(known) > 0.9


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], SCHEMA)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (3, None), (2, 7)], "doc_id long, quality int")
    got = labels.sample(docs, marks, "quality", 4, 2, 1000).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(i, i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    few = labels.sample(docs, marks, "quality", 4, 2, 3).collect()
    assert sorted(r["label"] for r in few) == [0, 0, 0, 1, 1, 1]


def test_subword_features():
    ids, owner = quality_classifier.word_features([b"abcd", b"e"])
    # a word, and its n-grams with both ends marked: <abcd> has 4 + 3 + 2, <e> has 1
    assert np.bincount(owner).tolist() == [10, 2] and len(ids) == 12
    at, n = quality_classifier.counted("a b a")
    assert n.sum() == 3 * 2 + 2 * 2  # a word with one n-gram, three times; two pairs, twice each
    assert len(quality_classifier.counted(None)[0]) == 0


def test_scorer_is_the_average_of_the_vectors():
    rng = np.random.default_rng(4)
    model = quality_classifier.train(["good words here", "bad spam spam", "", None], [1, 0, 1, 0], epochs=3)
    margins = model.margins()
    scorer = quality_classifier.Scorer(margins, float(model.bias[1] - model.bias[0]))
    texts = [" ".join(rng.choice(["good", "spam", "x", "déjà"], 30)) for _ in range(5)] + ["", None]
    for text, score in zip(texts, scorer.score_all(texts), strict=True):
        at, n = quality_classifier.counted(text)
        mean = (n / max(1, n.sum())) @ model.vectors[at] if len(at) else np.zeros(quality_classifier.DIM)
        z = np.diff(model.weights @ mean + model.bias)[0]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_ftrl_steps_follow_the_formula():
    model = toxicity.FTRL(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    at = np.array([3, 9, toxicity.BUCKETS])
    z, n = np.zeros(3), np.zeros(3)
    for label in (1, 1, 0, 1):
        w = np.where(np.abs(z) <= 0.1, 0, -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2))
        p = 1 / (1 + np.exp(-w.sum()))
        assert model.step(at, label) == pytest.approx(p)
        g = p - label
        z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
        n += g * g
    assert np.allclose(model.z[at], z) and np.allclose(model.n[at], n)
    at, w, _ = toxicity.train(["you idiot fool", "kind words"] * 20, [1, 0] * 20)
    assert 0 < len(at) < 20 and len(at) == len(w)  # few weights are not zero


def test_toxic_features_are_words_pairs_and_skips():
    f = toxicity.features
    assert len(f("a b c d")) == 4 + 3 + 2 and len(f(None)) == len(f("")) == 0
    assert set(f("You!")) == set(f("you")) and set(f("a b")) != set(f("b a"))


@pytest.mark.parametrize(("run", "label"), [(quality_classifier.classify, "quality"), (toxicity.toxicity, "toxic")])
def test_nulls_repeats_long_texts_empty_tables_and_clashing_columns(spark, run, label):
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], f"doc_id long, {label} int")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    schema = SCHEMA + ", SCORE string, label int, held_out int, _id int"
    assert run(spark.createDataFrame([], schema), marks).collect() == []
    rows = [(i, ("bad " if i % 2 == 0 else "good ") * 9, "s", 1, 2, 3) for i in range(300)] + [(100, None, "s", 1, 2, 3), (100, "", "s", 1, 2, 3), (None, "x", "s", 1, 2, 3), (101, "good " * 200_000, "s", 1, 2, 3)]
    out = run(spark.createDataFrame(rows, schema), marks)
    assert sorted(out.columns) == ["_id", "doc_id", "held_out", "label", "predicted", "score", "text"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert len(got) == len(rows) and got[100, None]["score"] == got[100, ""]["score"] and got[None, "x"]["held_out"] is False
    assert got[29, "good " * 9]["score"] > got[28, "bad " * 9]["score"]
    assert {r["score"] for r in run(spark.createDataFrame(rows, schema), none).collect()} == {0.5}


@pytest.mark.parametrize(("query", "label", "modulus", "remainder"), [("op4_subword_quality", "quality", 4, 2), ("op6_ftrl_toxicity", "toxic", 3, 1)])
def test_queries_equal_one_plain_program(spark, query, label, modulus, remainder):
    """All labelled rows outside the fold, in the order of their texts, one training, and each text's score by its
    formula."""
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r[label] in (0, 1) and r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % modulus != remainder:
            known[r["doc_id"]] = max(r[label], known.get(r["doc_id"], 0))
    rows = sorted((texts[i] or "", y, texts[i]) for i, y in known.items())
    if query == "op4_subword_quality":
        m = quality_classifier.train([t for _, _, t in rows], [y for _, y, _ in rows])

        def logit(t):
            at, n = quality_classifier.counted(t)
            mean = n @ m.vectors[at] / max(1, n.sum()) if len(at) else np.zeros(quality_classifier.DIM)
            return np.diff(m.weights @ mean + m.bias)[0]
    else:
        at, w, bias = toxicity.train([t for _, _, t in rows], [y for _, y, _ in rows])
        weights = dict(zip(at.tolist(), w.tolist(), strict=True))

        def logit(t):
            return bias + sum(weights.get(f, 0.0) for f in set(toxicity.features(t).tolist()))
    got = {r["doc_id"]: r for r in QUERIES[query](spark, sf).collect()}
    assert got.keys() == texts.keys() and len(rows) > 20
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(logit(t), -35, 35))), abs=1e-5)
