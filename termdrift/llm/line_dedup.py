"""Lines that many documents repeat (operator 3), in DataFrame functions alone.

Two passes over the lines. The first counts documents per key, combined before the shuffle, so a line that a third of
all rows hold is one row per task; its result is written, so that the join of the second, with the places that hold
the repeated keys, is one that Spark can split where a key is hot. Only hashes, ids and places are shuffled. The
lines to drop then meet their row, which its id and a hash of its whole text name; a bitmap of bounded size keeps the
other rows' texts out of that shuffle. Both joins are merges at every size, as either side grows with the corpus.

Null and empty texts are one empty line. A document with no id keeps all its lines. Rows with the same id count as one
document, so a line that only they hold stays in each of them, and each loses its own lines that repeat. Extra columns stay; those named n_lines, n_dropped or kept_text are replaced. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.llm.bitmap import split
from termdrift.llm.tables import fresh, without
from termdrift.scratch import Scratch

#: The blanks stripped from a line, and the letters that are folded.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashed(key: Column) -> Column:
    """128 bits, as two differently seeded hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _row() -> Column:
    """Names a row by its id and text; rows that repeat both lose the same places. Null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("row"), "doc_id", "text").alias("b")))


def _keys(documents: DataFrame, min_length: int) -> Column:
    """One hash per line, null for lines too short to count."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_length, _hashed(k)))


def repeated_lines(documents: DataFrame, min_length: int = 10, min_documents: int = 2) -> DataFrame:
    """key struct<a,b>, first_doc: the keys held by at least min_documents documents, and the smallest id among them."""
    named = documents.where(F.col("doc_id").isNotNull())
    held = named.select("doc_id", F.explode(F.array_distinct(_keys(documents, min_length))).alias("key")).where(F.col("key").isNotNull())
    if min_documents <= 2:  # two documents hold a key just when its smallest and its largest id differ
        counted = held.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        enough = F.col("last_doc") > F.col("first_doc") if min_documents == 2 else F.lit(True)
    else:
        counted = held.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count_distinct("doc_id").alias("n_documents"))
        enough = F.col("n_documents") >= min_documents
    return counted.where(enough).select("key", "first_doc")


def drop_repeated_lines(documents: DataFrame, min_length: int = 10, min_documents: int = 2) -> DataFrame:
    """documents with n_lines, n_dropped long and kept_text: every repeated line is gone but from the first document."""
    documents = without(documents, "n_lines", "n_dropped", "kept_text")
    held = documents.where(F.col("doc_id").isNotNull())
    places = held.select("doc_id", _row().alias("row"), F.posexplode(_keys(documents, min_length)).alias("at", "key")).where(F.col("key").isNotNull())
    with Scratch(documents.sparkSession, "line-dedup") as scratch:
        repeated = scratch.write(repeated_lines(documents, min_length, min_documents))
        row, dropped = fresh(documents, "_row"), fresh(documents, "_dropped")
        lost = places.join(repeated.hint("merge"), "key").where(F.col("doc_id") != F.col("first_doc"))
        lost = scratch.keep(lost.groupBy(F.col("row").alias(row)).agg(F.collect_set("at").alias(dropped)))
    losing, whole = split(documents, _row(), lost, row)
    joined = losing.join(lost.hint("merge"), _row() == F.col(row), "left").drop(row)
    every = joined.unionByName(whole.withColumn(dropped, F.lit(None).cast("array<int>")))
    lines = lines_of(F.col("text"))
    n, gone = F.size(lines), F.coalesce(dropped, F.array().cast("array<int>"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    return every.select(
        *documents.columns,
        n.cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        F.when(F.col(dropped).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
