import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import secrets
from colloquy.llm.queries import ORACLES
from tests.conftest import DATA
from tests.llm.test_line_dedup import brute as without_repeated_lines
from tests.llm.test_minhash import brute as components
from tests.llm.test_packing import check_places
from tests.oracle import connect

SF = f"{DATA}/sf0.001"


def test_run_equals_plain_stages(spark):
    con = connect(SF)
    kept = {r[0] for r in con.execute(f"select doc_id from ({ORACLES['op1_quality_rules']}) where kept").fetchall()}
    docs = sorted((i, t) for i, t in con.execute("select doc_id, text from documents").fetchall() if i in kept)
    assert 0 < len(docs) < con.execute("select count(*) from documents").fetchone()[0]
    docs = sorted(without_repeated_lines(docs).items())
    groups = components(docs, 5)
    docs = [(i, t) for i, t in docs if groups[i][1] == i]
    docs = [(i, secrets.redact(t, secrets.scan(t))) for i, t in docs]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in docs}
    out = corpus_pipeline.run(spark, SF).collect()
    have: dict = {}
    for r in out:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + r["length"]
    assert have == want and check_places(out, 2048) <= -(-sum(want.values()) // 2048) + 1


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "secret scans", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).collect() == []
    lines = corpus_pipeline.line_stage(spark, docs, SF)
    assert lines.where("n_chars <> length(text)").count() == 0


def test_stages_bear_nulls_long_texts_repeats_and_clashing_columns(spark):
    long = " ".join(f"word{i % 5000}x{i}" for i in range(200_000))
    plain = [" ".join(f"w{k}v{i}" for i in range(80)) for k in range(2)]
    line = "a line of more than forty characters that many documents hold"
    texts = [(1, plain[0]), (1, plain[0]), (2, plain[0]), (None, plain[0]), (None, plain[1]), (None, plain[1]), (3, None), (4, ""), (None, None), (5, long), *((10 + i, f"{line}\n" + " ".join(f"w{k}own{i}" for k in range(70))) for i in range(5))]
    extra = "kept string, _m int, n_words int, component_id int, _key int, secret_spans string, sequence_id string, piece int, key int, node int, host_rate int, _drop int, block int"
    names = [x.split()[0] for x in extra.split(", ")]
    rows = [(i, t, "en", None if k % 4 == 0 else "host", None if t is None else len(t), *(f"{n}{k}" if x.endswith("string") else k for n, x in zip(names, extra.split(", "), strict=True))) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    whole = {tuple(r[n] for n in names) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert len({r["_m"] for r in got}) == len(got) and {tuple(r[n] for n in names) for r in got} <= whole
        left = sorted(r["_m"] for r in got)
        texts_left = {r["_m"]: r["text"] for r in got}
        if name == "quality rules":
            assert left == [0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14]
        elif name == "near duplicates":
            assert len(left) == 15 - 4 and [x for x in left if 6 <= x <= 8] == [6, 7, 8] and any(x in left for x in (0, 1)) and 2 not in left and 3 not in left and 9 in left
        else:
            assert left == list(range(15))
        assert texts_left.get(9, long) == long and (name != "line dedup" or sum(line in (t or "") for t in texts_left.values()) == 1)
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert len({r["sequence_id"] for r in packed}) > 100 and sum(r["doc_id"] in (3, 4) for r in packed) == 2
