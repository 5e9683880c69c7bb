"""Growth between snapshots, and the terms within Tukey's fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.functions.quantiles import of_series, quantiles, stacked
from termdrift.functions.scalars import known, relative_change
from termdrift.schemas import GROWTH, NEW_COUNT, OLD_COUNT


def calculate_percent_change(counts: DataFrame, count_col_2016: str = OLD_COUNT, count_col_2024: str = NEW_COUNT, go_id_column: str = "go_id") -> DataFrame:
    """counts with pct_change_genes, a fraction. go_id_column changes nothing; callers may pass it."""
    return counts.withColumn(GROWTH, relative_change(F.col(count_col_2016), F.col(count_col_2024)))


def positive_growth(terms: DataFrame, pct_col: str = GROWTH) -> DataFrame:
    return terms.where(known(F.col(pct_col)) > 0)


def calculate_iqr_thresholds(df: DataFrame, gene_col: str = OLD_COUNT, pct_col: str = GROWTH) -> DataFrame:
    """One row: both columns' fences 1.5 quartile ranges beyond the quartiles, their medians, and the number of terms."""
    found = quantiles(stacked(df, [gene_col, pct_col]))
    q = lambda c: F.array(*[of_series(c, i) for i in range(3)])
    one = found.agg(q(gene_col).alias("g"), q(pct_col).alias("p"))
    one = df.agg(F.count(F.lit(1)).alias("total_terms")).crossJoin(F.broadcast(one))  # one row each
    at = lambda c, i: F.get(c, F.lit(i))
    low = lambda c: at(c, 0) - 1.5 * (at(c, 2) - at(c, 0))
    high = lambda c: at(c, 2) + 1.5 * (at(c, 2) - at(c, 0))
    return one.select(
        low("g").alias("min_genes"), high("g").alias("max_genes"), at("g", 1).alias("median_genes"),
        low("p").alias("min_pct_change"), high("p").alias("max_pct_change"), at("p", 1).alias("median_pct_change"), "total_terms",
    )


def filter_go_terms_iqr(df: DataFrame, thresholds: DataFrame, min_genes: int = 10, gene_col: str = OLD_COUNT, pct_col: str = GROWTH) -> DataFrame:
    """Terms of at least min_genes whose count and growth lie within the fences, ends included. thresholds: one row."""
    g, p = known(F.col(gene_col)), known(F.col(pct_col))
    fences = F.broadcast(thresholds.select("min_genes", "max_genes", "min_pct_change", "max_pct_change").toDF("_a", "_b", "_c", "_d"))
    inside = (g >= min_genes) & g.between(F.col("_a"), F.col("_b")) & p.between(F.col("_c"), F.col("_d"))
    return df.crossJoin(fences).where(inside).select(df.columns)


def retention(before: DataFrame, after: DataFrame, gene_col: str = OLD_COUNT) -> DataFrame:
    """One row: terms before and after, the share kept, and mean and median size of what was kept."""
    kept = after.agg(F.count(F.lit(1)).alias("n_after"), F.avg(gene_col).alias("mean_genes"))
    middle = quantiles(stacked(after, [gene_col]), [0.5]).agg(of_series(gene_col, 0).alias("median_genes"))
    both = before.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(middle))  # one row each
    return both.select("n_before", "n_after", F.try_divide("n_after", "n_before").alias("share_kept"), "mean_genes", "median_genes")
