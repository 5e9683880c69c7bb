"""A bounded sample of labelled documents, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: those whose crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label of at most `most` labelled rows that may be learned from, chosen by a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_texts(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label of the sample: at most `most` rows, so its labels may be broadcast. Of the texts that one id
    has, the least counts."""
    chosen = sample_labels(labels, label, most)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", label).agg(F.min("text").alias("text"))
