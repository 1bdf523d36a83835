"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns all that the next one works on, with the columns of documents;
the last returns the packed pieces. run() writes every stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import small_batches, store
from colloquy.llm.line_dedup import line_dedup
from colloquy.llm.minhash import keep_one
from colloquy.llm.packing import best_fit_packing
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.secrets import redact_secrets


#: The columns that stages work on; all others pass through them under other names, so that none can clash.
OWN = ("doc_id", "text", "source", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """docs with the columns beyond OWN renamed by their position."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"_c{i}") for i, c in enumerate(docs.columns)))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns again, in their order; n_chars, where there is one, follows the text."""
    own = {c: F.col(c if c in OWN else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length).alias("n_chars")
    return out.select(*own.values())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, by themselves or with their host, go; null and empty texts are among them."""
    small_batches(spark)
    return _back(quality_rules(_apart(docs)).where("kept"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; null texts become empty."""
    small_batches(spark)
    return _back(line_dedup(_apart(docs)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest
    doc_id; rows of one doc_id are one document, and those without come after all others."""
    small_batches(spark)
    return _back(keep_one(_apart(docs)), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; the documents stay, null texts too."""
    small_batches(spark)
    return _back(redact_secrets(_apart(docs)), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in the sequences; null texts are empty ones."""
    small_batches(spark)
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Near-duplicate groups, compressed sizes and tokenizers are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
