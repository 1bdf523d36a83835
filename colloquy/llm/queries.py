"""The opN queries over a folder of tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import ann, bpe
from colloquy.llm import line_dedup as lines
from colloquy.llm import maxent_lm, minhash, packing
from colloquy.llm import quality_classifier
from colloquy.llm import quality_rules as quality
from colloquy.llm import secrets, toxicity
from colloquy.llm.common import small_batches, store


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics are kept for the second use, the texts are not."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    ruled = store(quality.text_rules(docs).drop("text"), "ruled")
    return quality.judge(ruled).select("doc_id", *quality.NAMES, "base_failed", "kept")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)


def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_classifier.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash": op2_minhash,
    "op3_one_bit_codes": op3_one_bit_codes,
    "op4_subword_quality": op4_subword_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_ftrl_toxicity": op6_ftrl_toxicity,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
with w as (select doc_id, source, text, coalesce({_WORDS}, []) as ws from documents),
pos as (select doc_id, unnest(ws) as a, unnest(range(len(ws))) as i from w),
tri as (select doc_id, i, a, lead(a, 1) over p as b, lead(a, 2) over p as c from pos window p as (partition by doc_id order by i)),
rep as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k from tri where c is not null),
hit as (select doc_id, count(distinct i + d) as n from rep, (select unnest([0, 1, 2]) as d) where k >= 2 group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as l from documents),
dup as (select doc_id, count(*) - count(distinct l) as n from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (select w.doc_id, source, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(hit.n, 0) as bigint) as n_repeat_words
  from w left join hit using (doc_id) left join dup using (doc_id)),
r as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, cast(count(*) as double) as n, cast(count(*) filter (base_failed) as double) as f from r group by source),
s as (select count(*) as k, sum(n) as n, sum(f) as f, sum(n * n) as nn, sum(f * f / n) as ff from h),
p as (select f / n as mean, (ff - f * f / n - (k - 1) * (f / n) * (1 - f / n)) / nullif(n - nn / n, 0) as between_, k from s),
q as (select mean, case when k < 2 or mean * (1 - mean) <= 0 or between_ is null or between_ <= 0 then 1e6
    else least(greatest(mean * (1 - mean) / between_ - 1, 1.0), 1e6) end as strength from p),
v as (select source, (f + strength * mean) / (n + strength) > 0.5 as rejected from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from r join v on r.source is not distinct from v.source
"""

OP5_SQL = r"""
with l as (select doc_id, coalesce(nullif(text, ''), '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from l),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
d as (select k.*, often.key is not null and k.doc_id <> keeper as dropped from k left join often using (key))
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from d group by doc_id
"""

OP3_SQL = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

ORACLES = {"op3_one_bit_codes": OP3_SQL, "op1_quality_rules": OP1_SQL, "op5_line_dedup": OP5_SQL}
