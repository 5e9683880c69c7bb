"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path under the one that the cluster names in spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; any other master is an error, since its executors
    share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termdrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path: cuts the lineage, and outlives the executor that made a part of it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table of its own in the shared folder, for as long as that folder lasts."""
    return saved(df, shared_folder(df.sparkSession, purpose))


def bucketed(df: DataFrame, path: str, *keys: str, grouped: bool = False) -> DataFrame:
    """df as a table at path in as many buckets by keys as a shuffle has partitions, each of one file, so that joins and
    groups by keys read it without a shuffle. grouped: df comes out of a grouping by keys, so its rows lie by them already.
    The session's catalog names the table only until it is resolved."""
    spark, name = df.sparkSession, f"termdrift_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df if grouped else df.repartition(parts, *keys)
    dealt.write.format("parquet").option("path", path).bucketBy(parts, *keys).sortBy(*keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables of one job, as a context: what it writes goes at its end, what it keeps stays for the result's readers.
    last: the path of the table written last."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.folder, self.n = spark, shared_folder(spark, purpose), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, f"{self.folder}/rounds")

    def _next(self, kind: str) -> str:
        self.n += 1
        return f"{self.folder}/{kind}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        self.last = self._next("rounds")
        return saved(df, self.last)

    def bucketed(self, df: DataFrame, *keys: str, keep: bool = False, grouped: bool = False) -> DataFrame:
        return bucketed(df, self._next("kept" if keep else "rounds"), *keys, grouped=grouped)

    def drop(self, path: str) -> None:
        """Deletes a table of the job before its end, once nothing reads it any more."""
        remove(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        return saved(df, self._next("kept"))
