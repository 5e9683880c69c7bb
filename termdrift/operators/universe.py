"""Both snapshots over the same genes and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.functions.scalars import split_list, strip
from termdrift.schemas import NEW_COUNT, OLD_COUNT

#: The size of a usable term, and the mark of an elided gene.
SMALLEST, LARGEST, ELIDED = 2, 1000, "..."


def edge_list(cells: DataFrame, genes: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs from matrix cells (row, col, value): the nodes' (pos, identifier) by place; stored zeros are no edges."""
    cells = cells.where("value <> 0")
    by = lambda nodes, pos, name: nodes.select(F.col("pos").alias(pos), F.col("identifier").alias(name))
    joined = cells.join(by(genes, "row", "entrez_gene_id"), "row").join(by(terms, "col", "go_id"), "col")
    return joined.select("entrez_gene_id", F.lit("GpBP").alias("metaedge"), "go_id")


def matrix_shape(genes: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: how many nodes each side of the matrix has."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(genes, "n_rows").crossJoin(F.broadcast(n(terms, "n_cols")))  # one row each


def exploded(annotations: DataFrame) -> DataFrame:
    """One row per gene of a term. Both lists of a row must be equally long; a missing list is one missing gene.

    A gene id that is missing or no number is an error, as it must not be lost silently; elided genes go."""
    lists = annotations.withColumns({"_i": split_list(F.col("gene_ids")), "_s": split_list(F.col("gene_symbols"))})
    n = lambda c: F.coalesce(F.size(F.nullif(c, F.array().cast("array<string>"))), F.lit(-1))
    wrong = F.raise_error(F.lit("gene_ids and gene_symbols differ in length")).cast("array<struct<_i:string,_s:string>>")
    alike = F.col("_i").isNull() & F.col("_s").isNull() | (n(F.col("_i")) == n(F.col("_s")))
    same = F.when(alike, F.arrays_zip("_i", "_s")).otherwise(wrong)
    rows = lists.withColumn("_g", F.explode_outer(same)).withColumns({"gene_id": strip(F.col("_g._i")), "gene_symbol": strip(F.col("_g._s"))}).drop("_i", "_s", "_g")
    rows = rows.where(~F.col("gene_id").eqNullSafe(F.lit(ELIDED)))
    number = F.when(F.col("gene_id").isNull(), F.raise_error(F.lit("a gene id is missing")).cast("bigint")).otherwise(F.col("gene_id").cast("bigint"))
    return rows.withColumn("gene_id", number)


def of_domain(rows: DataFrame, domain: str = "biological_process") -> DataFrame:
    return rows.where(F.col("go_domain") == domain).select("go_id", "go_name", F.col("gene_id").alias("entrez_gene_id"), "gene_symbol")


def term_sizes(pairs: DataFrame, name: str) -> DataFrame:
    """Rows per term, repeated ones too."""
    return pairs.where(F.col("go_id").isNotNull()).groupBy("go_id").agg(F.count(F.lit(1)).alias(name))


def within(pairs: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of pairs whose key other has; repeated rows stay."""
    return pairs.join(other.select(key).distinct(), key, "left_semi").select(pairs.columns)


def size_band(pairs: DataFrame, low: int = SMALLEST, high: int = LARGEST) -> DataFrame:
    return within(pairs, term_sizes(pairs, "n").where(F.col("n").between(low, high)), "go_id")


def align_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new snapshot cut to the old one's genes, then to usable sizes, then to the old one's terms."""
    return within(size_band(within(new, old, "entrez_gene_id")), old, "go_id")


def align_old(old: DataFrame, aligned: DataFrame) -> DataFrame:
    """The old snapshot cut to the genes that are left in the new one."""
    return within(old, aligned, "entrez_gene_id")


def align(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both snapshots over common genes. More filters on the new one would change nothing, as its genes are among the old
    one's by then."""
    new = align_new(old, new)
    return align_old(old, new), new


def common_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    return term_sizes(old, OLD_COUNT).join(term_sizes(new, NEW_COUNT), "go_id")


def edge_counts(columns: tuple[str, ...] = ("entrez_gene_id", "metaedge", "go_id")) -> list[Column]:
    """The aggregates n_edges and n_nulls, for a table of pairs or for an observation of its writing."""
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in columns[1:]), F.sum(F.col(columns[0]).isNull().cast("long")))
    return [F.count(F.lit(1)).alias("n_edges"), F.coalesce(nulls, F.lit(0)).cast("long").alias("n_nulls")]


def quality_checks(pairs: DataFrame, edges: tuple[int, int] = (500_000, 1_500_000), genes: int = 14_000, terms: int = 5_000, counted: dict | None = None) -> DataFrame:
    """One row: edge, null, gene and term counts, and whether each is as expected, in one aggregation. counted: n_edges and
    n_nulls where the writing of pairs has told them; then only genes and terms are read."""
    known = [F.lit(counted[c]).cast("long").alias(c) for c in ("n_edges", "n_nulls")] if counted else edge_counts(tuple(pairs.columns))
    counts = pairs.agg(*([] if counted else known), F.count_distinct("entrez_gene_id").alias("n_genes"), F.count_distinct("go_id").alias("n_terms"))
    counts = counts.select(*(known if counted else ("n_edges", "n_nulls")), "n_genes", "n_terms")
    return counts.withColumns({
        "edges_ok": F.col("n_edges").between(*edges), "nulls_ok": F.col("n_nulls") == 0,
        "columns_ok": F.lit(set(pairs.columns) == {"entrez_gene_id", "metaedge", "go_id"}),
        "genes_ok": F.col("n_genes") >= genes, "terms_ok": F.col("n_terms") >= terms,
    })


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of either side, of both, and of one side alone."""
    mark = lambda df, x, y: df.select(key, F.lit(x).alias("x"), F.lit(y).alias("y"))
    each = mark(a, 1, 0).union(mark(b, 0, 1)).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    x, y = F.col("x"), F.col("y")
    return each.agg(n(x).alias("n_a"), n(y).alias("n_b"), n(x * y).alias("n_both"), n(x * (1 - y)).alias("n_only_a"), n(y * (1 - x)).alias("n_only_b"))
