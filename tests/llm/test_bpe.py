import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import bpe
from colloquy.llm.queries import QUERIES
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBPE(f.read())


PIECES = ["Hello", "world", "É", "é", "é", "ﬁ", "İ", "ß", "日本", "\U0001f600", "don't", "'s", "1234", "…", "<|endoftext|>", "<|startoftext|>", "<|", " ", "  ", "\n", "\t", " ", " ", "\x85", "\x00", "\x1f", "ing", "--", "a" * 40, "ab" * 300, "﻿"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=20).map("".join))
def test_ids_equal_the_librarys(library, ours, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ours.encode_text(text) == want
    assert ours.encode_text(text, leaf=16) == want
    assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_unsplit_text_is_joined_exactly(library, ours, seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "éèa", "日本語文字", "1", "aA1!-é日"])
    text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3000)))
    assert ours.encode_text(text, leaf=100) == library.encode(text, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    return [None, "", " ", "a", "Same", "Same", long, long, "x" * 70_000, "".join(rng.choice("abcdefghij") for _ in range(70_000)), f"{long[:20_000]}<|endoftext|>{long[:20_000]}"]


def test_texts_of_all_lengths(spark, library):
    texts = odd_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (3, "a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    have = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in got)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), ids, library.decode(ids, skip_special_tokens=False)))
    assert have == sorted(want)


def test_empty_table(spark):
    assert bpe.bpe_decode(bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).collect() == []


def test_query_equals_the_library_on_documents(spark, library):
    sf = f"{DATA}/sf0.001"
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = QUERIES["op9_bpe_tree"](spark, sf)
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
