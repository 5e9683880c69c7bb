"""Exact quantiles and ranks of many columns at once, by selection among ranges of values.

The values of all columns are stacked and counted, so that what repeats is one row, and dealt into ranges by column and
value. From the sums of the ranges alone it is known where each range begins among the ranks, so a quantile is sought in
the one or two ranges that hold its ranks, and a rank is worked out within its own range. No task holds more than a range.
The counted ranges are written, as their ends are sampled and a value must be in the same one wherever it is read; all else
is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termdrift.functions.scalars import known
from termdrift.scratch import bucketed, shared_folder

QUARTILES = (0.25, 0.5, 0.75)


def stacked(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """series, value double: all known values of the columns; the series is the column's name, with `by` a struct of
    that and of the row's group."""
    name = lambda c: F.struct(F.lit(c).alias("column"), F.col(by).alias("group")) if by else F.lit(c)
    each = F.explode(F.array(*[F.struct(name(c).alias("series"), known(F.col(c)).alias("value")) for c in columns]))
    return df.select(each.alias("x")).select("x.*").where("value IS NOT NULL")


def ranges(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """series, value, n and range, counted and written; and series, range, before (how many values are in the ranges before
    it), inside and total, a row for each range of a series."""
    parts = max(1, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = series.groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(parts, "series", "value").withColumn("range", F.spark_partition_id())
    counted = bucketed(dealt, shared_folder(series.sparkSession, "ranges"), "range", grouped=True)  # read by range without a shuffle
    sums = counted.groupBy("series", "range").agg(F.sum("n").alias("inside"))
    own = Window.partitionBy("series")
    before = F.coalesce(F.sum("inside").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted, sums.withColumns({"before": before, "total": F.sum("inside").over(own)})


def quantiles(series: DataFrame, shares: Sequence[float] = QUARTILES) -> DataFrame:
    """series, n long and q array<double>, the exact quantiles at the shares, by linear interpolation between neighbours.
    A series without values has no row."""
    counted, sums = ranges(series)
    place = lambda total: F.transform(F.array(*map(F.lit, shares)), lambda s: s * (total - 1))
    ranks = F.array_distinct(F.flatten(F.transform(place(F.col("total")), lambda at: F.array(F.floor(at), F.ceil(at)))))
    here = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("inside")))
    sought = sums.select("series", "range", "before", "total", here.alias("ranks")).where(F.size("ranks") > 0)  # at most two for each share
    run = F.sum("n").over(Window.partitionBy("series", "range").orderBy("value"))
    held = counted.join(sought, ["series", "range"]).withColumn("to", F.col("before") + run)
    found = held.select("series", "value", "total", F.explode(F.filter("ranks", lambda r: (r < F.col("to")) & (r >= F.col("to") - F.col("n")))).alias("rank"))
    values = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    each = found.groupBy("series").agg(F.max("total").alias("n"), values.alias("at"))  # two ranks for each share at most

    def value(at: Column) -> Column:
        lower, upper, part = F.element_at("at", F.floor(at)), F.element_at("at", F.ceil(at)), at - F.floor(at)
        return F.when((part == 0) | (lower == upper), lower).otherwise(lower * (1 - part) + upper * part)

    return each.select("series", "n", F.transform(place(F.col("n")), value).alias("q"))


def of_series(name: str, i: int) -> Column:
    """Within an aggregate over what quantiles() gives: the i-th quantile of a series, null where it has no values."""
    return F.max(F.when(F.col("series") == name, F.get("q", F.lit(i))))


def average_ranks(series: DataFrame) -> DataFrame:
    """series, value, rank double: of every value among its series, from 1; equal values share the mean of their ranks."""
    counted, sums = ranges(series)
    run = F.sum("n").over(Window.partitionBy("series", "range").orderBy("value"))
    placed = counted.withColumn("to", run).join(sums.select("series", "range", "before"), ["series", "range"])
    return placed.select("series", "value", (F.col("before") + F.col("to") - (F.col("n") - 1) / 2).alias("rank"))
