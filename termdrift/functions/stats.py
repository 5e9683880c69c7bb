"""Statistics of columns, each an aggregation or a few; quantiles and ranks by ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.functions.quantiles import average_ranks, of_series, quantiles, stacked
from termdrift.functions.scalars import known
from termdrift.scratch import written


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, p25, p50, p75, max; quantiles exact, by linear interpolation."""
    c = known(F.col(column))
    moments = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = quantiles(stacked(df, [column])).agg(*[of_series(column, i).alias(f"p{p}") for i, p in enumerate((25, 50, 75))])
    return moments.crossJoin(F.broadcast(q)).select("count", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row each


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 0), low, high, count: bins of equal width from the least to the largest value, the last one closed.

    df is read three times, so give one that is written. All bins are there, empty ones too. If all values are equal the range is half a unit to both sides."""
    c = known(F.col(column))
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo IS NOT NULL")
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    placed = df.select(c.alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(ends))
    counted = placed.select((F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins)) - 1).cast("int").alias("bin")).groupBy("bin").count()
    width = (F.col("hi") - F.col("lo")) / bins
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda bin: F.col("lo") + bin * width
    held = frame.join(counted, "bin", "left")
    return held.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def rank_correlations(df: DataFrame, columns: list[str], against: str) -> DataFrame:
    """measure, r, p, n: a row for each of the columns, with its rank correlation with `against` and the p value of that.

    Rows where any of them is missing are left out; a constant column has no correlation, and without rows n is 0. All
    columns are ranked together, and all correlations are one aggregation. df is read twice, so it is written first."""
    every = [*columns, against]
    rows = df.select(*[known(F.col(c)).alias(f"_{k}") for k, c in enumerate(every)]).na.drop().withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "correlations")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(f"_{k}").alias("value")) for k in range(len(every))]))
    series = rows.select("_row", each.alias("x")).select("_row", "x.*")
    ranked = series.join(average_ranks(series.select("series", "value")), ["series", "value"])
    wide = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("series") == k, F.col("rank"))).alias(f"_{k}") for k in range(len(every))])
    y = F.col(f"_{len(columns)}")
    r = lambda x: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[r(F.col(f"_{k}")).alias(f"r{k}") for k in range(len(columns))])
    told = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"r{k}").alias("r")) for k, c in enumerate(columns)])).alias("x"))
    return told.select("x.measure", "x.r", correlation_p(F.col("x.r"), F.col("n")).alias("p"), "n")


def _ln_gamma_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a): the asymptotic series at a + 10, and ten steps down from there."""
    b = a + 10
    far = F.log(b) / 2 - 1 / (8 * b) + 1 / (192 * b**3) - 1 / (640 * b**5) + 17 / (14336 * b**7)
    return far + sum(F.log((a + k) / (a + k + 0.5)) for k in range(10))


def student_p(t: Column, freedom: Column, terms: int = 300) -> Column:
    """Two-sided probability of a t value at least this far from 0: the incomplete beta function of x = freedom / (freedom +
    t^2) at freedom / 2 and 1/2, by its continued fraction, which is folded term by term."""
    x = freedom / (freedom + t * t)
    a, half = (freedom / 2).cast("double"), F.lit(0.5)
    front = F.exp(_ln_gamma_step(a) - 0.5723649429247001 + a * F.log(x) + half * F.log1p(-x))  # ln of gamma(1/2)
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(state: Column, m: Column) -> Column:
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / safe(1 + top * state["d"]), safe(1 + top / state["c"])
                state = F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))
            return state

        first = 1 / safe(1 - (a + b) * x / (a + 1))
        whole = F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double"))
        return F.aggregate(whole, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])

    near = front * fraction(a, half, x) / a
    far = 1 - front * fraction(half, a, 1 - x) / half
    return F.when(x >= 1, 1.0).when(x <= 0, 0.0).when(x < (a + 1) / (a + half + 2), near).otherwise(far)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p value of a rank correlation, by Student's t with n - 2 degrees of freedom; null below three rows."""
    freedom = (n - 2).cast("double")
    return F.when(r.isNotNull() & (n >= 3), F.when(F.abs(r) >= 1, 0.0).otherwise(student_p(r * F.sqrt(freedom / (1 - r * r)), freedom)))


def by_bin(df: DataFrame, group: str, column: str) -> DataFrame:
    """mean, median and count of column in each bin that occurs."""
    c, inside = known(F.col(column)), df.where(F.col(group).isNotNull())
    counts = inside.groupBy(group).agg(F.avg(c).alias("mean"), F.count(c).alias("count"))
    middle = quantiles(stacked(inside, [column], by=group), [0.5]).select(F.col("series.group").alias(group), F.get("q", F.lit(0)).alias("median"))
    return counts.join(middle, group, "left").select(group, "mean", "median", "count")


def null_cells(df: DataFrame) -> DataFrame:
    """One row: nulls long, over all cells."""
    each = [F.sum(F.col(c).isNull().cast("long")) for c in df.columns]
    return df.agg(F.coalesce(sum(each[1:], each[0]), F.lit(0)).cast("long").alias("nulls"))


def frequency(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, the most frequent first; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def missing_names(df: DataFrame, expected: set[str]) -> set[str]:
    """Names that only one side has; empty if the columns are as expected."""
    return set(df.columns) ^ expected
