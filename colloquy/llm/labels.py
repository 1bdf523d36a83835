"""Labelled rows for training, without the held-out fold: bounded, chosen by hash, texts whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(modulus)), F.lit(0).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_label: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of per_label documents at most for each of labels 0 and 1, in hash order.

    Labels that are null or for held-out documents are never read. A document labelled twice counts with its
    larger label. The chosen ids are 2 * per_label at most, so they are broadcast.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id", modulus) != held_out))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    pick = lambda value: known.where(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
    chosen = pick(0).unionByName(pick(1))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
