from collections import defaultdict

from colloquy.llm import line_dedup as ld
from colloquy.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import connect, same

SCHEMA = "doc_id long, text string"
LINE = "A line that is long enough to be looked at by the rule"


def brute(docs, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ld.SPACE))
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in docs}


def test_query_equals_its_sql(spark):
    sf = f"{DATA}/sf0.01"
    assert same(QUERIES["op5_line_dedup"](spark, sf), connect(sf), ORACLES["op5_line_dedup"])


def odd_docs():
    docs = [(i, f"own {i}\n{LINE}\nend\n") for i in range(4)]
    docs += [(4, f"\t{LINE.upper()} \x0b\n{LINE}"), (5, None), (6, ""), (7, f"\x1c{LINE}\n" + "\n".join(f"{'long' * 12}{n}" for n in range(3000)))]
    docs += [(10 + i, f"{'é' * 40}\n{'É' * 40}\n{'z' * 39}") for i in range(5)]
    return docs


def test_lines_equal_those_of_brute_force(spark):
    docs = odd_docs()
    got = {r["doc_id"]: r for r in ld.line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = brute(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[4]["n_dropped"] == 0 and got[0]["n_dropped"] == 1 and got[7]["n_lines"] == 3001 and got[10]["text"] == "z" * 39
    assert all(r["n_lines"] == (dict(docs)[i] or "").count("\n") + 1 for i, r in got.items())


def test_many_shards_and_blocks_change_nothing(spark):
    docs = odd_docs()
    got = ld.line_dedup(spark.createDataFrame(docs, SCHEMA), shard_keys=64, block_keys=16).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(docs)


def test_hot_keys_and_others_give_the_same(spark, monkeypatch):
    docs = [(i, f"{LINE} {i % 7}\n{LINE}\n{LINE} own {i}") for i in range(150)]
    want = brute(docs)
    for hot in (1, 64, 10_000):
        monkeypatch.setattr(ld, "HOT_DOCS", hot)
        assert {r["doc_id"]: r["text"] for r in ld.line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()} == want


def test_few_unique_lines_are_suspects_at_a_hundred_shards(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 50), k -> concat('{LINE} ', id, ' ', k)), '\\n') as text")
    twice = docs.where("doc_id < 20").selectExpr("doc_id + 5000 as doc_id", "text")
    held = ld.suspects(docs.unionByName(twice), "doc_id", "text", 40, shard_keys=1000, block_keys=5000).groupBy("_id").count().collect()
    n = {r["_id"]: r["count"] for r in held}
    assert all(n[i] == n[i + 5000] == 50 for i in range(20))  # none that repeats is lost
    assert sum(c for i, c in n.items() if 20 <= i < 5000) < 0.05 * 99_000


def test_repeated_rows_are_one_document_and_null_ids_the_smallest(spark):
    four = [(1, LINE), (1, LINE), (1, LINE), (None, LINE), (2, LINE), (3, LINE)]
    got = ld.line_dedup(spark.createDataFrame(four, SCHEMA)).collect()
    assert all(r["text"] == LINE for r in got)  # four documents hold it
    got = ld.line_dedup(spark.createDataFrame([*four, (4, LINE)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


def test_empty_tables_and_clashing_columns(spark):
    schema = SCHEMA + ", key int, N_LINES string, _drop int, _id int, extra int"
    assert ld.line_dedup(spark.createDataFrame([], schema)).collect() == []
    out = ld.line_dedup(spark.createDataFrame([(1, "a\nb", 7, "x", 1, 2, 3)], schema))
    assert [c.lower() for c in out.columns].count("n_lines") == 1 and out.first()["key"] == 7 and out.first()["extra"] == 3 and out.first()["n_lines"] == 2
