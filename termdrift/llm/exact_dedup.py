"""Exact deduplication by a stateful stream (operator 8).

Arrivals (digest, id, locator) stream, a share of the files at a time, into state that is kept by digest on disk, in
RocksDB, and never expires: for each digest the id and the locator of the row that stays, and how many rows came.
Arrivals of a digest are combined before they are shuffled, so a third of all rows with one text is one row per task.
Every batch writes the digests that it changed; a batch that is run again after a failure overwrites its own output.

The locator is the file of a row and its place there. Tables that are not read from Parquet have none; there the id
alone locates. A digest that came more than once is a hit, and only the bytes decide: the whole text of each hit is
compared with that of the row that stays, which its locator tells from the others. Only texts whose digest may be a hit
are shuffled; a bitmap of bounded size tells which. Its joins are merges at every size, as all sides grow. Where bytes
differ, the rows of that digest are grouped by their whole text instead.

Null text counts as empty, so it equals an empty text. Of equal texts the row with the largest doc_id stays. A row
without id is never kept when another has one; its bytes are checked like any others, and among rows without id all
show as kept. Rows that repeat both id and text count in group_size, and each of them shows as kept. Extra columns
stay; those named keep_id, group_size or kept are replaced. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.llm.bitmap import split
from termdrift.llm.tables import fresh, without
from termdrift.scratch import Scratch

#: State on disk; a store per partition, most of them small, so none claims disk space ahead.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = "struct<file:string,row:bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(documents: DataFrame, name: str) -> DataFrame:
    """documents with the locator of each row, null where the source gives none."""
    try:
        return documents.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    except AnalysisException:  # no files, or files without row numbers
        return documents.withColumn(name, F.lit(None).cast(LOCATOR))


def stream_groups(arrivals_path: str, schema, spark, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """digest, keep_id, keep_at, group_size, from a stream over the files of arrivals_path.

    Run again on the same folder with more files, it goes on from its state."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = reader.parquet(arrivals_path).groupBy("digest").agg(F.max(F.struct("doc_id", "at")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/changed/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    kinds = f"digest binary, keeper struct<doc_id:long,at:{LOCATOR}>, group_size long, batch int"
    changed = spark.read.schema(kinds).parquet(f"{folder}/changed")
    last = changed.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("g"))
    return last.select("digest", F.col("g.keeper.doc_id").alias("keep_id"), F.col("g.keeper.at").alias("keep_at"), "g.group_size")


def mark_copies(documents: DataFrame, digest=sha256, batches: int = 2) -> DataFrame:
    """documents with keep_id, group_size long, kept boolean. digest: any function of the text; only speed hangs on it.
    batches: in how many the stream takes the arrivals."""
    spark = documents.sparkSession
    documents = without(documents, "keep_id", "group_size", "kept")
    if documents.isEmpty():
        return documents.withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(0).cast("long"), "kept": F.lit(False)})
    text, own_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    key, at = fresh(documents, "_digest"), fresh(documents, "_at")
    rows = located(documents, at).withColumn(key, digest(text).cast("binary"))
    with Scratch(spark, "exact-dedup") as scratch:
        arrivals = scratch.write(rows.select(own_id.alias("doc_id"), F.col(key).alias("digest"), F.col(at).alias("at")))
        files = max(1, -(-len(arrivals.inputFiles()) // batches))
        groups = stream_groups(scratch.last, arrivals.schema, spark, f"{scratch.folder}/rounds", files)
        multiple = scratch.keep(groups.where("group_size > 1"))

        hit, _ = split(rows.select(own_id.alias("hit_id"), text.alias("bytes"), F.col(at).alias("hit_at"), F.col(key).alias("digest")), F.col("digest"), multiple, "digest")
        stays = hit.join(multiple.select("digest", "keep_id", "keep_at").hint("merge"), "digest").where(F.col("hit_id").eqNullSafe(F.col("keep_id")) & F.col("hit_at").eqNullSafe(F.col("keep_at")))
        stays = stays.groupBy("digest").agg(F.min("bytes").alias("kept_bytes"))  # one row; without locators, rows that repeat an id
        differing = hit.join(scratch.write(stays).hint("merge"), "digest").where("bytes <> kept_bytes").select("digest")
        shared = scratch.keep(differing.distinct())

    maybe, single = split(rows, F.col(key), multiple, "digest")
    outputs = ["keep_id", "group_size"]
    alone = single.select("*", own_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = maybe.join(multiple.select(F.col("digest").alias(key), "keep_id", "group_size").hint("merge"), key, "left")
    many = found.select(*[maybe[c] for c in maybe.columns], F.when(F.col("group_size").isNull(), own_id).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if not shared.isEmpty():  # two texts of one digest
        whole, keep, size = (fresh(many, n) for n in ("_bytes", "_keep", "_size"))
        again = rows.join(shared.select(F.col("digest").alias(key)), key).select(key, text.alias(whole), own_id.alias("doc_id"))
        exact = again.groupBy(key, whole).agg(F.max("doc_id").alias(keep), F.count(F.lit(1)).alias(size))
        many = many.withColumn(whole, text).join(exact, [key, whole], "left")
        many = many.withColumns({"keep_id": F.when(F.col(size).isNull(), F.col("keep_id")).otherwise(F.col(keep)), "group_size": F.coalesce(size, "group_size")})
    columns = [*documents.columns, *outputs]
    out = alone.select(*columns).unionByName(many.select(*columns))
    return out.withColumn("kept", own_id.eqNullSafe(F.col("keep_id")))
