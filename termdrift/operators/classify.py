"""Pairs of two snapshots: which stayed, which came, which went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.functions.scalars import share

KEY = ("go_id", "entrez_gene_id")


def typed(pairs: DataFrame) -> DataFrame:
    """With the gene id as a long, so that both snapshots compare by value."""
    return pairs.withColumn("entrez_gene_id", F.col("entrez_gene_id").cast("bigint"))


def stable_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old whose pair new has; repeated rows stay."""
    return typed(old).join(typed(new).select(*KEY), list(KEY), "left_semi").select(old.columns)


def added_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose pair old lacks; repeated rows stay."""
    return typed(new).join(typed(old).select(*KEY), list(KEY), "left_anti").select(new.columns)


def removed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    return added_pairs(new, old)


def pair_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """go_id, entrez_gene_id, n_old, n_new long: every pair of either snapshot, and in how many rows each has it. A pair with
    a missing end is like no other, so each side has it by itself. Sides bucketed by pair meet without a shuffle."""
    count = lambda df, name: typed(df).groupBy(*KEY).agg(F.count(F.lit(1)).alias(name))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return count(old, "n_old").join(count(new, "n_new").hint("merge"), list(KEY), "full").select(*KEY, zero("n_old"), zero("n_new"))


#: What a class's rows are, by the number of rows of both snapshots.
ROWS = {"old": "n_old", "new": "n_new", "stable": "IF(n_new > 0, n_old, 0)", "added": "IF(n_old = 0, n_new, 0)"}


def by_term(classes: DataFrame) -> DataFrame:
    """go_id, distinct genes in each class (n_genes_2016, n_genes_2024, n_stable, n_added), and rows in each (ROWS)."""
    gene = F.col("entrez_gene_id").isNotNull()
    old, new = F.col("n_old") > 0, F.col("n_new") > 0
    genes = {"n_genes_2016": old, "n_genes_2024": new, "n_stable": old & new, "n_added": ~old}
    counts = [F.count_if(c & gene).alias(name) for name, c in genes.items()]
    return classes.groupBy("go_id").agg(*counts, *[F.sum(F.expr(rows)).alias(f"rows_{name}") for name, rows in ROWS.items()])


def by_gene(classes: DataFrame) -> DataFrame:
    """entrez_gene_id, and rows in each class."""
    return classes.groupBy("entrez_gene_id").agg(*[F.sum(F.expr(rows)).alias(f"rows_{name}") for name, rows in ROWS.items()])


def summary_of(terms: DataFrame) -> DataFrame:
    """What class_summary gives, from by_term."""
    return terms.where(F.col("go_id").isNotNull()).select(
        "go_id", "n_genes_2016", "n_genes_2024", "n_stable", "n_added",
        (F.col("n_genes_2016") - F.col("n_stable")).alias("n_removed"),
        share(F.col("n_stable"), F.col("n_genes_2024")).alias("pct_stable"),
        share(F.col("n_added"), F.col("n_genes_2024")).alias("pct_added"),
    )


def class_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct genes per term: in each snapshot, stable, added, removed, and two shares in percent; a term of one snapshot
    alone has zeros for the other."""
    return summary_of(by_term(pair_classes(old, new)))


def classify_genes_stable_added(genes_2016: DataFrame, genes_2024: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return stable_pairs(genes_2016, genes_2024), added_pairs(genes_2016, genes_2024), class_summary(genes_2016, genes_2024)


def top_added(summary: DataFrame, named: DataFrame, k: int = 10) -> DataFrame:
    """The k terms with most added genes, ties by id, with each of a term's names."""
    names = named.select("go_id", "go_name").dropDuplicates()
    top = summary.orderBy(F.desc("n_added"), "go_id").limit(k)
    return top.join(names, "go_id", "left").select("go_id", "go_name", "n_genes_2024", "n_stable", "n_added", "pct_added")


def with_class_counts(terms: DataFrame, summary: DataFrame) -> DataFrame:
    return terms.join(summary.select("go_id", "n_stable", "n_added"), "go_id", "left")
