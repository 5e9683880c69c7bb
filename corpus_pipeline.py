"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that the stage before kept, and its decisions take effect: the documents that the
quality classifier rejects go, of equal texts one stays, of each group of near duplicates one stays, personal data is
replaced by its kind in brackets, and what is left is packed into sequences.

Null and empty texts get the mean label of the labelled sample and stay if that is at least 0.7; they are equal to each
other, so one stays, as a text of the closing id alone. Of rows that repeat a text one stays, that with the largest id,
and of rows that repeat both id and text the one with the least other columns. Rows that repeat an id with other texts are
documents of their own: of near copies one row stays, that with the smallest id, of several the one whose text's hash is the
least, and unlike texts of one id all stay. Rows without id are never held to be near copies. An empty table goes through as an empty table. Columns other than those of documents are
dropped by the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termdrift.llm import exact_dedup, near_dedup, packing, pii, quality
from termdrift.llm.bitmap import split
from termdrift.llm.tables import read, small_batches
from termdrift.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.score_documents(docs, read(spark, sf_dir, "labels")).where("score >= 0.7").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a text: of rows that repeat both id and text, which are all kept, the one with the least other columns."""
    kept = exact_dedup.mark_copies(docs).where("kept")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    repeated = kept.where("group_size > 1").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    one = repeated.agg(F.min("text").alias("text"), F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    return kept.where("group_size = 1").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    small_batches(spark)
    gone = near_dedup.mark_rows(docs).where("NOT stays").select(F.col("row").alias("gone"), F.xxhash64("row").alias("key")).distinct()
    maybe, stays = split(docs, F.xxhash64(near_dedup.row_of(docs)), gone, "key")
    maybe = maybe.join(gone.hint("merge"), near_dedup.row_of(maybe) == F.col("gone"), "left_anti")
    return stays.select(*COLUMNS).unionByName(maybe.select(*COLUMNS))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(docs).withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("pii", redacted), ("packing", packed)]

#: The classifier, the trees and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each result is written to the shared folder and read again for the next. What the last
    one returns stays there, the others go."""
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark, "pipeline") as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
