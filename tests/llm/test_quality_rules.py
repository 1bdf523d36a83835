from colloquy.llm import quality_rules as q
from colloquy.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, same

SF = f"{DATA}/sf0.001"


def slow_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_query_equals_its_sql(spark):
    assert same(QUERIES["op1_quality_rules"](spark, SF), connect(SF), ORACLES["op1_quality_rules"])


def test_measures():
    assert q.measure(None) == q.measure("") == (0, 0, 0, 0, 0)
    assert q.measure("a\x0bb\x1cc d\n\n  \nd\nd") == (5, 7, 0, 1, 0)  # \x1c is no white space here, blank lines count nothing
    assert q.measure("#é|x <\U0001f600>") == (2, 7, 4, 0, 0)
    for text in ("a b c a b c", "a a a a", "a b c d", "a b a b a b", "x " * 5000 + "y"):
        words = text.split()
        assert q.repeated_words(words) == (slow_repeats(words) if len(words) < 100 else 5000)
    many = [f"w{i}" for i in range(2_000_001)]  # the other way to number windows
    assert q.repeated_words([*many, "w5", "w6", "w7"]) == 6


def test_hosts_that_fail_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "x") for i in range(40)] + [(100, "bad", good), (101, "ok", good), (102, None, good), (103, None, None), (103, None, None)] + [(200 + i, "ok", good) for i in range(40)]
    got = q.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(rows) and kept[100] is False and kept[101] is True and kept[103] is False and not any(kept[i] for i in range(40))
    assert {r["base_failed"] for r in got if r["doc_id"] == 100} == {False}


def test_large_host_tables_are_joined_by_shuffle(spark, monkeypatch):
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"h{i % 7}" if i % 11 else None, "x" if i % 7 < 3 else good) for i in range(200)], "doc_id long, source string, text string")
    want = sorted((r["doc_id"], r["kept"], round(r["host_rate"], 12)) for r in q.quality_rules(docs).collect())
    monkeypatch.setattr(q, "SMALL", 0)
    assert sorted((r["doc_id"], r["kept"], round(r["host_rate"], 12)) for r in q.quality_rules(docs).collect()) == want and len(want) == 200


def test_prior():
    assert q.beta_prior(0, 0, 0, 0, 0) == (1e6, 0.0)
    assert q.beta_prior(1, 10, 5, 100, 2.5) == (1e6, 0.5)  # one host is the corpus
    assert q.beta_prior(2, 20, 10, 200, 5.0)[0] == 1e6  # alike
    assert q.beta_prior(2, 20, 10, 200, 10.0)[0] == 1.0  # as different as can be


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, source string, text string, N_WORDS int, kept string, _host int, host_rate int, _m int, extra int"
    assert q.quality_rules(spark.createDataFrame([], schema)).collect() == []
    out = q.quality_rules(spark.createDataFrame([(1, "s", "a b", 9, "no", 3, 4, 5, 6)], schema))
    row = out.first()
    assert row["extra"] == 6 and row["n_words"] == 2 and row["kept"] is False and out.columns.count("kept") == 1
