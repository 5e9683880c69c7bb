"""The whole comparison of two snapshots, from pairs to datasets."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termdrift.functions import stats
from termdrift.functions.quantiles import of_series, quantiles, stacked
from termdrift.functions.scalars import bin_order, depth_bin
from termdrift.operators import classify, growth, ontology, universe
from termdrift.schemas import GROWTH, NEW_COUNT, OLD_COUNT
from termdrift.scratch import Scratch, written
from termdrift.sources import files


def growth_terms(common: DataFrame, summary: DataFrame) -> DataFrame:
    return growth.calculate_percent_change(classify.with_class_counts(common, summary))


class Comparison:
    """What two snapshots tell of each other. Pairs are written before their alignment, and after it bucketed by pair, so
    that their classes and what is made from these need no further shuffle by pair. The tables with a row for each term or
    gene that all others are made from are written when first asked for, and what their writing counts is kept: metrics."""

    def __init__(self, old: DataFrame, new: DataFrame, min_genes: int = 10):
        self.min_genes, self.metrics = min_genes, {}
        with Scratch(old.sparkSession, "compare") as scratch:
            old, new = scratch.write(old), scratch.write(new)
            by_pair = lambda df: scratch.bucketed(classify.typed(df), *classify.KEY, keep=True)
            self.new_pairs = by_pair(universe.align_new(old, new))
            self.old_pairs = by_pair(universe.align_old(old, self.new_pairs))

    def _observed(self, df: DataFrame, key: str) -> DataFrame:
        """df, a row for each value of key, written; and from that writing the rows and values of each class."""
        told, known = Observation(), F.col(key).isNotNull()
        rows = [F.sum(f"rows_{c}").alias(f"rows_{c}") for c in classify.ROWS]
        found = written(df.observe(told, *rows, *[F.count_if(known & (F.col(f"rows_{c}") > 0)).alias(f"{key}_{c}") for c in classify.ROWS]), f"by-{key}")
        self.metrics |= {k: v or 0 for k, v in told.get.items()}
        return found

    @cached_property
    def by_term(self) -> DataFrame:
        return self._observed(classify.by_term(classify.pair_classes(self.old_pairs, self.new_pairs)), "go_id")

    @cached_property
    def by_gene(self) -> DataFrame:
        return self._observed(classify.by_gene(classify.pair_classes(self.old_pairs, self.new_pairs)), "entrez_gene_id")

    @cached_property
    def common_terms(self) -> DataFrame:
        """The terms of both snapshots with their rows in each, from the table by term."""
        both = self.by_term.where("go_id IS NOT NULL AND rows_old > 0 AND rows_new > 0")
        return both.select("go_id", F.col("rows_old").alias(OLD_COUNT), F.col("rows_new").alias(NEW_COUNT))

    @cached_property
    def stable(self) -> DataFrame:
        return classify.stable_pairs(self.old_pairs, self.new_pairs)

    @cached_property
    def added(self) -> DataFrame:
        return classify.added_pairs(self.old_pairs, self.new_pairs)

    @cached_property
    def removed(self) -> DataFrame:
        return classify.removed_pairs(self.old_pairs, self.new_pairs)

    @cached_property
    def summary(self) -> DataFrame:
        return classify.summary_of(self.by_term)

    @cached_property
    def growth(self) -> DataFrame:
        """The common terms with their stable and added genes and their growth; by_term holds all of it in a row."""
        both = self.by_term.where("go_id IS NOT NULL AND rows_old > 0 AND rows_new > 0")
        counts = both.select("go_id", F.col("rows_old").alias(OLD_COUNT), F.col("rows_new").alias(NEW_COUNT), "n_stable", "n_added")
        return growth.calculate_percent_change(counts)

    @cached_property
    def thresholds(self) -> DataFrame:
        return growth.calculate_iqr_thresholds(growth.positive_growth(self.growth))

    @cached_property
    def dataset1_all_growth(self) -> DataFrame:
        return growth.filter_go_terms_iqr(growth.positive_growth(self.growth), self.thresholds, self.min_genes)


def compare(old: DataFrame, new: DataFrame, min_genes: int = 10) -> Comparison:
    return Comparison(old, new, min_genes)


def load_pairs(spark, matrix: str, gene_nodes: str, term_nodes: str, annotations: str, metaedge_checks: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Both snapshots from their files: the old one's sparse matrix with its two node files, and the new one's table of
    annotations. metaedge_checks: bounds for universe.quality_checks on the old one; a bound not met is an error."""
    genes, terms = files.read_nodes(spark, gene_nodes, "bigint"), files.read_nodes(spark, term_nodes)
    told = Observation()  # edges and missing cells are counted as the edges are written
    old = written(universe.edge_list(files.read_matrix(spark, matrix), genes, terms).observe(told, *universe.edge_counts()), "old-edges")
    if metaedge_checks is not None:
        found = universe.quality_checks(old, **metaedge_checks, counted=told.get).first().asDict()
        if wrong := sorted(k for k, v in found.items() if k.endswith("_ok") and not v):
            raise ValueError(f"{matrix} fails {wrong}: {found}")
    table = files.read_table(spark, annotations, "go_id string, go_name string, go_domain string, gene_ids string, gene_symbols string", sep="\t")
    return old, universe.of_domain(universe.exploded(table))


def write_datasets(found: Comparison, terms: DataFrame, folder: str, hierarchy: DataFrame | None = None) -> None:
    """The five tables of a comparison as CSV: both snapshots' pairs, the common terms with their growth, the terms
    within the fences, and of those the leaves and the direct parents of leaves, both in one table by level. hierarchy: the
    common terms with the columns of both hierarchies; the tables of terms then have these too."""
    more = None if hierarchy is None else hierarchy.select("go_id", *[c for c in hierarchy.columns if c not in found.growth.columns])
    wide = lambda df: df if more is None else df.join(more, "go_id", "left")
    leaves, parents = by_level(found.dataset1_all_growth, terms)
    levels = leaves.withColumn("level", F.lit("leaf")).unionByName(parents.withColumn("level", F.lit("parent")))
    tables = {"old_pairs": found.old_pairs, "new_pairs": found.new_pairs, "common_terms": wide(found.growth), "dataset1_all_growth": wide(found.dataset1_all_growth), "dataset2_levels": wide(levels)}
    for name, df in tables.items():
        files.write_csv(df, f"{folder}/{name}")


def analyse(
    spark, matrix: str, gene_nodes: str, term_nodes: str, annotations: str, ontologies: tuple[str, str], folder: str,
    metaedge_checks: dict | None = None, min_genes: int = 10, stanza_mode: str = "compat",
) -> Comparison:
    """The whole analysis, from the files of both snapshots to the tables and the report in folder: the datasets with the
    columns of both hierarchies, the metrics of pairs, classes and datasets, the correlations of growth with depth, growth
    by depth, the ten terms with most added genes, and the histogram of stable genes."""
    old, new = load_pairs(spark, matrix, gene_nodes, term_nodes, annotations, metaedge_checks)
    names = new.select("go_id", "go_name")
    found = compare(old, new.select("go_id", "entrez_gene_id"), min_genes)
    before, after = (written(files.read_ontology(spark, path, stanza_mode), "ontology") for path in ontologies)
    hierarchy = written(ontology.add_hierarchy_metrics(found.growth, before, after), "hierarchy")
    write_datasets(found, after, folder, hierarchy)
    report = {
        "pair_metrics": pair_metrics(found), "class_metrics": class_metrics(found), "dataset_metrics": dataset_metrics(found, after),
        "depth_correlations": depth_correlations(hierarchy), "growth_by_depth": growth_by_depth(hierarchy),
        "top_added": classify.top_added(found.summary, names), "stable_histogram": stats.histogram(found.summary, "n_stable"),
    }
    for name, df in report.items():
        files.write_csv(df, f"{folder}/report/{name}", single=True)  # at most a row for each measure, bin or of ten terms
    return found


def pair_metrics(found: Comparison) -> DataFrame:
    """A row for each table of pairs: rows, distinct terms and distinct genes. They were counted as the tables by term and
    by gene were written, so nothing is read for them."""
    found.by_term, found.by_gene  # noqa: B018
    of = lambda name, c: F.lit(int(found.metrics[f"{name}_{c}"])).cast("long")
    rows = [F.struct(F.lit(c).alias("pairs"), of("rows", c).alias("n_pairs"), of("go_id", c).alias("n_terms"), of("entrez_gene_id", c).alias("n_genes")) for c in classify.ROWS]
    return found.old_pairs.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def class_metrics(found: Comparison) -> DataFrame:
    """One row: the number of terms, mean genes of a term in each class, and the median shares in percent."""
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    counts = found.summary.agg(F.count(F.lit(1)).alias("n_terms"), *[mean(c) for c in ("n_genes_2016", "n_genes_2024", "n_stable", "n_added")])
    shares = ("pct_stable", "pct_added")
    middle = quantiles(stacked(found.summary, shares), [0.5]).agg(*[of_series(c, 0).alias(f"median_{c}") for c in shares])
    return counts.crossJoin(F.broadcast(middle))  # one row each


def dataset_metrics(found: Comparison, terms: DataFrame) -> DataFrame:
    """A row for each dataset: terms, mean and median size in the old snapshot, and the share of dataset 1 it keeps."""
    leaves, parents = by_level(found.dataset1_all_growth, terms)
    tables = {"dataset1_all_growth": found.dataset1_all_growth, "dataset2_leaves": leaves, "dataset2_parents": parents}
    marked = reduce(DataFrame.union, [df.select(F.lit(name).alias("dataset"), OLD_COUNT) for name, df in tables.items()])
    marked = written(marked, "datasets")
    counts = marked.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_terms"), F.avg(OLD_COUNT).alias("mean_genes"))
    middle = quantiles(stacked(marked, [OLD_COUNT], by="dataset"), [0.5]).select(F.col("series.group").alias("dataset"), F.get("q", F.lit(0)).alias("median_genes"))
    names = marked.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, tables))).alias("dataset"))
    rows = names.join(counts, "dataset", "left").join(middle, "dataset", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("long")))
    whole = rows.where(F.col("dataset") == "dataset1_all_growth").select(F.col("n_terms").alias("all_terms"))  # one row
    return rows.crossJoin(F.broadcast(whole)).withColumn("retention", F.try_divide("n_terms", "all_terms")).drop("all_terms")


def by_level(dataset: DataFrame, terms: DataFrame, namespace: str = ontology.PROCESS) -> tuple[DataFrame, DataFrame]:
    """The dataset's leaves, and its direct parents of leaves."""
    leaves = ontology.identify_leaf_terms(terms, namespace)
    parents = ontology.identify_parent_terms(leaves, terms, namespace)
    return dataset.join(leaves, "go_id", "left_semi"), dataset.join(parents, "go_id", "left_semi")


DEPTHS = ("normalized_depth_2016", "normalized_depth_2024", "norm_depth_change")


def with_depths(hierarchy: DataFrame) -> DataFrame:
    """The terms whose depth in both snapshots and whose growth are known."""
    return hierarchy.na.drop(subset=["normalized_depth_2016", "normalized_depth_2024", GROWTH])


def depth_correlations(hierarchy: DataFrame) -> DataFrame:
    """measure, r, p, n: rank correlations of growth with both depths and with their change."""
    return stats.rank_correlations(with_depths(hierarchy), list(DEPTHS), GROWTH)


def growth_by_depth(hierarchy: DataFrame) -> DataFrame:
    """Growth by depth of the old snapshot: depth_bin_2016, mean, median, count, bin_order."""
    binned = with_depths(hierarchy).select(depth_bin(F.col("normalized_depth_2016")).alias("depth_bin_2016"), GROWTH)
    return stats.by_bin(written(binned, "depth-bins"), "depth_bin_2016", GROWTH).withColumn("bin_order", bin_order(F.col("depth_bin_2016")))
