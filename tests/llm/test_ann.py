import numpy as np

from colloquy.llm import ann
from colloquy.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, same

SCHEMA = "vec_id long, embedding array<float>"


def test_query_equals_its_sql(spark):
    assert same(QUERIES["op3_one_bit_codes"](spark, f"{DATA}/sf0.001"), connect(f"{DATA}/sf0.001"), ORACLES["op3_one_bit_codes"])


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ann, "GROUP", 1)
    sf = f"{DATA}/sf0.01"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, v = np.array([i for i, _ in vectors]), np.array([e for _, e in vectors], np.float64)
    got: dict = {}
    for r in QUERIES["op3_one_bit_codes"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(want & got[int(ids[q])]), total + len(want)
    assert total and hits / total >= 0.99


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 48)) + 1
    codes = ann.Codes(v.mean(axis=0))
    queries = v[:40]
    est, half = codes.estimate(queries, *codes.encode(v))
    assert half.mean() < 0.25 * np.linalg.norm(queries, axis=1).mean() * np.linalg.norm(v - codes.centroid, axis=1).mean()
    outside = np.abs(est - queries @ v.T) > half
    assert outside.mean() < 0.005 and (np.abs(est - queries @ v.T)[outside] < 2 * half[outside]).all()
    assert np.allclose(codes.rotation.T @ codes.rotation, np.eye(48)) and codes.encode(v)[0].shape == (500, ann.BITS // 8)


def test_bounds_leave_few_exact_comparisons(spark):
    """At most a fifth of all pairs on 2000 vectors, and every true neighbour among them."""
    rows = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    codes = ann.Codes(v.mean(axis=0))
    block = ann.Held(codes, ids, v, *codes.encode(v))
    at = np.flatnonzero(ids % 20 == 0)
    asked = ann.Asked(codes, ids[at], v[at], 20)
    asked.meet(block)
    assert asked.compared <= 0.2 * len(at) * len(ids)
    for q, (got, _) in zip(at, asked.best, strict=True):
        s = v @ v[q]
        s[q] = -np.inf
        assert set(got.tolist()) == set(ids[np.lexsort((ids, -s))[:20]].tolist())


def test_queries_of_one_id_are_one_query(spark):
    df = spark.createDataFrame([(20, [2.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])], SCHEMA)
    got = ann.nearest(df, df.where("vec_id = 20")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 2, 3.0), (20, 2, 1, 1.0)]


def test_nulls_ties_repeats_and_few_candidates(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 0.0]), (120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 5.0]), (3, [-1.0, 1.0]), (3, [-1.0, 1.0]), *bad], SCHEMA)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0), (0, 4, 3, -1.0)]
    assert got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, none).collect() == []
    some = spark.createDataFrame([(1, [1.0]), (2, [2.0])], SCHEMA)
    assert ann.nearest(some, none).collect() == []
    wide = spark.createDataFrame([(20, [1.0], 5, "x", 1.0), (2, [2.0], 6, "y", 2.0)], SCHEMA + ", rank int, block string, score double")
    assert [tuple(r) for r in ann.nearest(wide, wide.where("vec_id = 20")).collect()] == [(20, 1, 2, 2.0)]
