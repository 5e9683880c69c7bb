"""The operators as queries over the shared test tables, with the SQL that gives the same rows.

Line items stand for annotations: parts are terms, suppliers genes, and a cut in the shipping date parts the
snapshots. Parts also make up two ontologies, and documents the sets whose overlap is clustered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termdrift.functions import stats
from termdrift.operators import classify, growth, ontology, overlap, universe
from termdrift.plans import snapshot
from termdrift.schemas import COMMON_TERMS, GROWTH, NEW_COUNT, OLD_COUNT
from termdrift.scratch import shared_folder
from termdrift.sources import files

CUT = "1998-03-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, new: bool, term: str = "l_partkey", gene: str = "l_suppkey") -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    side = F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz") if new else F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    return rows.where(side).select(F.col(term).cast("string").alias("go_id"), F.col(gene).alias("entrez_gene_id")).distinct()


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = compared(spark, sf_dir)
    return found.old_pairs, found.new_pairs


def compared(spark: SparkSession, sf_dir: str) -> snapshot.Comparison:
    return snapshot.compare(pairs(spark, sf_dir, False), pairs(spark, sf_dir, True))


def terms(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    k = F.col("p_partkey")
    up = F.array(F.floor(k / 2), F.floor(k / (5 if new else 3)))
    parents = F.transform(F.filter(F.array_distinct(up), lambda p: (p > 0) & (p != k)), lambda p: p.cast("string"))
    space = F.when(F.col("p_size") <= 40, ontology.PROCESS).otherwise("other")
    return table(spark, sf_dir, "part").select(k.cast("string").alias("id"), parents.alias("parents"), space.alias("namespace"), (F.col("p_size") == 7).alias("obsolete"))


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def hierarchy(spark, sf_dir):
    return ontology.add_hierarchy_metrics(compared(spark, sf_dir).growth, terms(spark, sf_dir, False), terms(spark, sf_dir, True))


GROWTH_COLUMNS = ("go_id", OLD_COUNT, NEW_COUNT, "n_stable", "n_added")


def shown(df: DataFrame) -> DataFrame:
    return df.select(*GROWTH_COLUMNS, r6(GROWTH))


def edge_list(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1998-03-01'")
    cells = rows.select((F.col("l_suppkey") - 1).alias("row"), (F.col("l_partkey") - 1).alias("col"), F.lit(1).alias("value")).distinct()
    genes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("pos"), F.col("s_suppkey").alias("identifier"))
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("pos"), F.col("p_partkey").cast("string").alias("identifier"))
    return universe.edge_list(cells, genes, nodes)


def term_frequency(spark, sf_dir):
    return stats.frequency(pairs(spark, sf_dir, False), "go_id", OLD_COUNT)


def term_sizes(spark, sf_dir):
    return universe.term_sizes(pairs(spark, sf_dir, True), NEW_COUNT)


def term_size_band(spark, sf_dir):
    return universe.size_band(pairs(spark, sf_dir, True), 2, 12)


def universe_align(spark, sf_dir):
    old, new = both(spark, sf_dir)
    return old.withColumn("side", F.lit("old")).union(new.withColumn("side", F.lit("new")))


def key_range(key):
    """So many keys make one list or text, whatever the table's size."""
    return F.floor(key / 500).alias("key_range")


def parallel_explode(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lists = p.groupBy("p_brand", key_range(F.col("p_partkey"))).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    joined = lambda f: F.array_join(F.transform("x", lambda s: f(s)), "|")
    annotations = lists.select(
        F.col("p_brand").alias("go_id"), F.col("p_brand").alias("go_name"), F.lit("biological_process").alias("go_domain"),
        F.concat(F.lit("...|"), joined(lambda s: F.concat(F.lit("\t"), s["p_partkey"].cast("string"), F.lit(" ")))).alias("gene_ids"),
        F.concat(F.lit("...|"), joined(lambda s: F.concat(F.lit(" "), s["p_name"]))).alias("gene_symbols"),
    )
    return universe.of_domain(universe.exploded(annotations))


def common_terms(spark, sf_dir):
    return compared(spark, sf_dir).common_terms


def stable_pairs(spark, sf_dir):
    return compared(spark, sf_dir).stable


def added_pairs(spark, sf_dir):
    return compared(spark, sf_dir).added


def removed_pairs(spark, sf_dir):
    return compared(spark, sf_dir).removed


def class_summary(spark, sf_dir):
    s = compared(spark, sf_dir).summary
    return s.select(*s.columns[:-2], r6("pct_stable"), r6("pct_added"))


def top_added(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("go_id"), F.col("p_name").alias("go_name"))
    return classify.top_added(compared(spark, sf_dir).summary, names).withColumn("pct_added", r6("pct_added"))


def class_counts_join(spark, sf_dir):
    c = compared(spark, sf_dir)
    return classify.with_class_counts(c.common_terms, c.summary)


def pct_change(spark, sf_dir):
    return shown(compared(spark, sf_dir).growth)


def positive_growth(spark, sf_dir):
    return shown(growth.positive_growth(compared(spark, sf_dir).growth))


def iqr_thresholds(spark, sf_dir):
    t = compared(spark, sf_dir).thresholds
    return t.select(*[r6(c) for c in t.columns[:-1]], "total_terms")


def iqr_filtered(spark, sf_dir):
    return shown(compared(spark, sf_dir).dataset1_all_growth)


def depths(spark, sf_dir):
    return ontology.depths(terms(spark, sf_dir, False))


def norm_depths(spark, sf_dir):
    d = ontology.normalised_depths(terms(spark, sf_dir, True))
    return d.withColumn("normalized_depth", r6("normalized_depth"))


def hierarchy_metrics(spark, sf_dir):
    h = hierarchy(spark, sf_dir)
    return h.select("go_id", "depth_2016", r6("normalized_depth_2016"), "depth_2024", r6("normalized_depth_2024"), "depth_change", r6("norm_depth_change"))


def leaf_terms(spark, sf_dir):
    return ontology.identify_leaf_terms(terms(spark, sf_dir, True))


def leaf_parents(spark, sf_dir):
    t = terms(spark, sf_dir, True)
    return ontology.identify_parent_terms(ontology.identify_leaf_terms(t), t)


def dataset_leaves(spark, sf_dir):
    return shown(snapshot.by_level(compared(spark, sf_dir).dataset1_all_growth, terms(spark, sf_dir, True))[0])


def dataset_parents(spark, sf_dir):
    return shown(snapshot.by_level(compared(spark, sf_dir).dataset1_all_growth, terms(spark, sf_dir, True))[1])


def spearman_depth_growth(spark, sf_dir):
    return snapshot.depth_correlations(hierarchy(spark, sf_dir)).select("measure", r6("r"), "n")


def depth_bins(spark, sf_dir):
    return snapshot.growth_by_depth(hierarchy(spark, sf_dir)).select("depth_bin_2016", "bin_order", r6("mean"), r6("median"), "count")


def describe_depth(spark, sf_dir):
    d = stats.describe(hierarchy(spark, sf_dir), "normalized_depth_2016")
    return d.select("count", *[r6(c) for c in d.columns[1:]])


def hist_stable_30(spark, sf_dir):
    h = stats.histogram(compared(spark, sf_dir).summary, "n_stable")
    return h.select("bin", r6("low"), r6("high"), "count")


def growth_scatter(spark, sf_dir):
    return compared(spark, sf_dir).summary.select("n_stable", "n_added")


def null_audit(spark, sf_dir):
    return stats.null_cells(edge_list(spark, sf_dir))


def quality_checks(spark, sf_dir):
    return universe.quality_checks(edge_list(spark, sf_dir), (20_000, 40_000), 100, 1_900)


def set_counts(spark, sf_dir):
    return universe.set_counts(pairs(spark, sf_dir, False), pairs(spark, sf_dir, True), "go_id")


def retention(spark, sf_dir):
    c = compared(spark, sf_dir)
    r = growth.retention(growth.positive_growth(c.growth), c.dataset1_all_growth)
    return r.select("n_before", "n_after", r6("share_kept"), r6("mean_genes"), r6("median_genes"))


def words(spark, sf_dir) -> DataFrame:
    """id, items: the distinct words of each document that has one."""
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    found = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\t\n\r]+", -1)), lambda x: x != "")
    each = d.select(F.col("doc_id").alias("id"), found.alias("items")).where("size(items) > 0")
    lists = each.groupBy("id").agg(F.collect_list("items").alias("lists"))  # of one row, but where an id repeats
    return lists.select("id", F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(F.array_distinct(F.flatten("lists"))).alias("items"))


def overlapped(spark, sf_dir) -> overlap.Overlap:
    w = overlap.stored_sets(words(spark, sf_dir))
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("go_id"), F.col("n_chars").alias(NEW_COUNT))
    dataset = w.select(F.col("id").alias("go_id"), F.size("items").cast("long").alias(OLD_COUNT)).join(n, "go_id")
    return overlap.filter_overlapping_go_terms(w.select("id"), overlap.set_cluster_links(w), dataset, sets=w)


def jaccard_pairs(spark, sf_dir):
    w = overlap.stored_sets(words(spark, sf_dir))
    return overlap.expanded(*overlap.set_links(w, 0.85)).where("jaccard > 0.9").select("a", "b", r6("jaccard"))


def components(spark, sf_dir):
    w = overlap.stored_sets(words(spark, sf_dir))
    return overlap.clusters(w.select("id"), overlap.set_cluster_links(w))


def overlap_filtered(spark, sf_dir):
    return overlapped(spark, sf_dir).filtered


def overlap_removed(spark, sf_dir):
    r = overlapped(spark, sf_dir).removal
    return r.select(*[r6(c) if c in ("jaccard_similarity", "removed_pct_change", "kept_pct_change") else c for c in r.columns])


def overlap_map(spark, sf_dir):
    return overlapped(spark, sf_dir).removed_terms


def cluster_sizes(spark, sf_dir):
    return overlapped(spark, sf_dir).cluster_stats


def ontology_parse(spark, sf_dir):
    """The parts as the texts of an ontology, one for each range of keys, parsed back."""
    t = terms(spark, sf_dir, False)
    stanza = F.concat_ws(
        "\n", F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("namespace: "), "namespace"),
        F.array_join(F.transform("parents", lambda p: F.concat(F.lit("is_a: "), p, F.lit(" ! name"))), "\n"), F.when(F.col("obsolete"), "is_obsolete: true"), F.lit(""),
    )
    stanzas = F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"])
    whole = F.concat(F.lit("format-version: 1.2\n"), F.array_join(stanzas, "\n")).alias("value")
    text = t.select(stanza.alias("s"), "id").groupBy(key_range(F.col("id").cast("long"))).agg(whole)
    return files.parse_ontology(text).select("id", F.array_join(F.array_sort("parents"), ",").alias("parents"), "namespace", "obsolete")


def csv_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "common-terms-csv")
    files.write_csv(compared(spark, sf_dir).common_terms, path)
    return files.read_table(spark, path, COMMON_TERMS)


def spearman_p_values(spark, sf_dir):
    return snapshot.depth_correlations(hierarchy(spark, sf_dir)).select("measure", r6("r"), r6("p"), "n")


def matrix_shape(spark, sf_dir):
    return universe.matrix_shape(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"))


def pair_metrics(spark, sf_dir):
    return snapshot.pair_metrics(compared(spark, sf_dir))


def class_metrics(spark, sf_dir):
    m = snapshot.class_metrics(compared(spark, sf_dir))
    return m.select("n_terms", *[r6(c) for c in m.columns[1:]])


def dataset_metrics(spark, sf_dir):
    m = snapshot.dataset_metrics(compared(spark, sf_dir), terms(spark, sf_dir, True))
    return m.select("dataset", "n_terms", *[r6(c) for c in m.columns[2:]])


def nodes_roundtrip(spark, sf_dir):
    """The parts as node files in the order of their keys, read back with their places."""
    path = shared_folder(spark, "nodes")
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.col("p_partkey").cast("string").alias("identifier"), F.col("p_name").alias("name"))
    ids.orderBy("position").write.csv(path, sep="\t", header=True)
    return files.read_nodes(spark, path)


def ids_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "ids")
    files.write_ids(ontology.identify_leaf_terms(terms(spark, sf_dir, True)), path)
    return files.read_ids(spark, path)


def cached_roundtrip(spark, sf_dir):
    """Leaves made once and read from the cache the second time."""
    folder = shared_folder(spark, "cache")
    files.cached(spark, folder, "leaves", [sf_dir], lambda: ontology.identify_leaf_terms(terms(spark, sf_dir, True)))
    return files.cached(spark, folder, "leaves", [sf_dir], lambda: terms(spark, sf_dir, True).where("false").select(F.col("id").alias("go_id")))


def graph_roundtrip(spark, sf_dir):
    """Parts, suppliers and the pairs of both as a graph, written by kind and metaedge and read back."""
    folder = shared_folder(spark, "graph")
    node = lambda name, kind, key, label: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("identifier"), F.col(label).alias("name"))
    nodes = node("part", "Term", "p_partkey", "p_name").union(node("supplier", "Gene", "s_suppkey", "s_name"))
    side = lambda kind, c: F.array(F.lit(kind), F.col(c).cast("string"))
    old = pairs(spark, sf_dir, False)
    edges = old.select(F.lit("participates").alias("kind"), side("Gene", "entrez_gene_id").alias("source"), side("Term", "go_id").alias("target"), F.lit("both").alias("direction"))
    files.write_graph(nodes, edges, folder)
    back = spark.read.parquet(f"{folder}/edges").where("metaedge = 'participates'")
    named = spark.read.parquet(f"{folder}/nodes").where("kind = 'Term'").select(F.col("identifier").alias("go_id"), F.col("name").alias("go_name"))
    return back.select(F.get("source", F.lit(1)).cast("bigint").alias("entrez_gene_id"), F.get("target", F.lit(1)).alias("go_id")).join(named, "go_id")


def graph_documents(spark, sf_dir):
    """The same graph as documents, one for each range of parts, written compressed and read back as streams."""
    path = shared_folder(spark, "graph-documents")
    end = lambda kind, c: F.array(F.lit(kind), F.col(c).cast("string"))
    edge = F.struct(end("Gene", "entrez_gene_id").alias("source_id"), end("Term", "go_id").alias("target_id"), F.lit("participates").alias("kind"), F.lit("both").alias("direction"))
    edges = pairs(spark, sf_dir, False).groupBy(key_range(F.col("go_id").cast("long"))).agg(F.collect_list(edge).alias("edges"))
    node = F.struct(F.lit("Term").alias("kind"), F.col("p_partkey").alias("identifier"), F.col("p_name").alias("name"))
    nodes = table(spark, sf_dir, "part").groupBy(key_range(F.col("p_partkey"))).agg(F.collect_list(node).alias("nodes"))
    document = F.to_json(F.struct(F.array(F.lit("Gene"), F.lit("Term")).alias("metanode_kinds"), "nodes", "edges"))
    nodes.join(edges, "key_range", "left").select(document).write.text(path, compression="gzip")
    nodes, edges = files.read_graph(spark, path)
    named = nodes.select(F.col("identifier").alias("go_id"), F.col("name").alias("go_name"))
    ends = edges.select(F.get("source", F.lit(1)).cast("bigint").alias("entrez_gene_id"), F.get("target", F.lit(1)).alias("go_id"))
    return ends.join(named, "go_id")


QUERIES = {f.__name__: f for f in (
    edge_list, term_frequency, term_sizes, term_size_band, universe_align, parallel_explode, common_terms, stable_pairs, added_pairs, removed_pairs,
    class_summary, top_added, class_counts_join, pct_change, positive_growth, iqr_thresholds, iqr_filtered, depths, norm_depths, hierarchy_metrics,
    leaf_terms, leaf_parents, dataset_leaves, dataset_parents, spearman_depth_growth, depth_bins, describe_depth, hist_stable_30, growth_scatter,
    null_audit, quality_checks, set_counts, retention, jaccard_pairs, components, overlap_filtered, overlap_removed, overlap_map, cluster_sizes,
    ontology_parse, csv_roundtrip, spearman_p_values, matrix_shape, pair_metrics, class_metrics, dataset_metrics, nodes_roundtrip, ids_roundtrip,
    cached_roundtrip, graph_roundtrip, graph_documents,
)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that grew, within the fences, with at least ten old genes; suppliers as terms."""
    old, new = (pairs(spark, sf_dir, side, "l_suppkey", "l_partkey") for side in (False, True))
    return shown(snapshot.compare(old, new).dataset1_all_growth)


_PAIRS = f"""
    old0 AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS go_id, l_suppkey AS entrez_gene_id FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),
    new0 AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS go_id, l_suppkey AS entrez_gene_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"""
_ALIGNED = f"""{_PAIRS},
    new1 AS (SELECT * FROM new0 WHERE entrez_gene_id IN (SELECT entrez_gene_id FROM old0)),
    new2 AS (SELECT * FROM new1 WHERE go_id IN (SELECT go_id FROM new1 GROUP BY go_id HAVING count(*) BETWEEN 2 AND 1000)),
    new AS (SELECT * FROM new2 WHERE go_id IN (SELECT go_id FROM old0)),
    old AS (SELECT * FROM old0 WHERE entrez_gene_id IN (SELECT entrez_gene_id FROM new))"""
_GROWTH = f"""{_ALIGNED},
    common AS (
        SELECT o.go_id, o.n AS {OLD_COUNT}, n.n AS {NEW_COUNT}
        FROM (SELECT go_id, count(*) AS n FROM old GROUP BY go_id) o JOIN (SELECT go_id, count(*) AS n FROM new GROUP BY go_id) n ON o.go_id = n.go_id),
    marked AS (SELECT go_id, entrez_gene_id, max(o) AS o, max(n) AS n FROM (
        SELECT *, 1 AS o, 0 AS n FROM old UNION ALL SELECT *, 0, 1 FROM new) GROUP BY go_id, entrez_gene_id),
    summary AS (
        SELECT go_id, CAST(sum(o) AS BIGINT) AS n_genes_2016, CAST(sum(n) AS BIGINT) AS n_genes_2024, CAST(sum(o * n) AS BIGINT) AS n_stable,
               CAST(sum(n * (1 - o)) AS BIGINT) AS n_added, CAST(sum(o * (1 - n)) AS BIGINT) AS n_removed FROM marked GROUP BY go_id),
    growth AS (
        SELECT c.*, s.n_stable, s.n_added, (c.{NEW_COUNT} - c.{OLD_COUNT}) / CAST(c.{OLD_COUNT} AS DOUBLE) AS {GROWTH}
        FROM common c LEFT JOIN summary s ON c.go_id = s.go_id),
    growing AS (SELECT * FROM growth WHERE {GROWTH} > 0),
    q AS (
        SELECT quantile_cont({OLD_COUNT}::DOUBLE, 0.25) AS g1, quantile_cont({OLD_COUNT}::DOUBLE, 0.5) AS g2, quantile_cont({OLD_COUNT}::DOUBLE, 0.75) AS g3,
               quantile_cont({GROWTH}, 0.25) AS p1, quantile_cont({GROWTH}, 0.5) AS p2, quantile_cont({GROWTH}, 0.75) AS p3, count(*) AS total_terms FROM growing),
    dataset1 AS (
        SELECT growing.* FROM growing, q WHERE {OLD_COUNT} >= 10 AND {OLD_COUNT} BETWEEN g1 - 1.5 * (g3 - g1) AND g3 + 1.5 * (g3 - g1)
        AND {GROWTH} BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1))"""


def _terms(year: str, divisor: int) -> str:
    return f"""
    up{year} AS (
        SELECT p_partkey AS k, p_size <= 40 AND p_size <> 7 AS live, unnest([p_partkey // 2, p_partkey // {divisor}]) AS p FROM part),
    e{year} AS (SELECT DISTINCT u.k, u.p FROM up{year} u JOIN part x ON u.p = x.p_partkey AND x.p_size <= 40 AND x.p_size <> 7 WHERE u.live AND u.p > 0 AND u.p <> u.k),
    live{year} AS (SELECT p_partkey AS k FROM part WHERE p_size <= 40 AND p_size <> 7),
    walk{year} AS (
        SELECT k, 0 AS depth FROM live{year} WHERE k NOT IN (SELECT k FROM e{year})
        UNION SELECT e.k, w.depth + 1 FROM walk{year} w JOIN e{year} e ON e.p = w.k),
    depth{year} AS (SELECT k, min(depth) AS depth FROM walk{year} GROUP BY k),
    norm{year} AS (SELECT CAST(k AS VARCHAR) AS go_id, depth, max(depth) OVER () AS max_depth, depth / CAST(max(depth) OVER () AS DOUBLE) AS normalized_depth FROM depth{year}),
    leaf{year} AS (SELECT CAST(k AS VARCHAR) AS go_id, k FROM live{year} WHERE k NOT IN (SELECT p FROM e{year})),
    above{year} AS (SELECT DISTINCT CAST(e.p AS VARCHAR) AS go_id FROM e{year} e JOIN leaf{year} l ON e.k = l.k)"""


_OLD_TERMS, _NEW_TERMS = _terms("2016", 3), _terms("2024", 5)
_HIERARCHY = f"""{_GROWTH}, {_OLD_TERMS}, {_NEW_TERMS},
    h AS (
        SELECT g.*, a.depth AS depth_2016, a.normalized_depth AS normalized_depth_2016, b.depth AS depth_2024, b.normalized_depth AS normalized_depth_2024,
               b.depth - a.depth AS depth_change, b.normalized_depth - a.normalized_depth AS norm_depth_change
        FROM growth g LEFT JOIN norm2016 a ON g.go_id = a.go_id LEFT JOIN norm2024 b ON g.go_id = b.go_id),
    whole AS (SELECT * FROM h WHERE normalized_depth_2016 IS NOT NULL AND normalized_depth_2024 IS NOT NULL AND {GROWTH} IS NOT NULL)"""
_EDGES = "SELECT entrez_gene_id, 'GpBP' AS metaedge, go_id FROM old0"
_SHOWN = f"go_id, {OLD_COUNT}, {NEW_COUNT}, n_stable, n_added, round({GROWTH}, 6) AS {GROWTH}"
_WORDS = r"""
    words AS (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r]+')) AS item FROM documents),
    w AS (SELECT * FROM words WHERE item <> ''),
    n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
    c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM w x JOIN w y ON x.item = y.item AND x.id < y.id GROUP BY x.id, y.id),
    j AS (SELECT a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS jaccard FROM c JOIN n x ON a = x.id JOIN n y ON b = y.id),
    both_ways AS (SELECT a, b FROM j WHERE jaccard > 0.9 UNION ALL SELECT b, a FROM j WHERE jaccard > 0.9),
    reach AS (SELECT id, id AS r FROM n UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
    placed AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""
_OVERLAP = f"""{_WORDS},
    sizes AS (SELECT component, count(*) AS cluster_size FROM placed GROUP BY component),
    rows_ AS (
        SELECT p.id AS go_id, n.n AS {OLD_COUNT}, d.n_chars AS {NEW_COUNT}, p.component, s.cluster_size, abs((d.n_chars - n.n) / CAST(n.n AS DOUBLE) * 100) AS pct_change
        FROM placed p JOIN n ON p.id = n.id JOIN documents d ON d.doc_id = p.id JOIN sizes s ON p.component = s.component),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY pct_change DESC, go_id) AS r FROM rows_) WHERE r = 1),
    removal AS (
        SELECT x.go_id AS removed_go_id, k.go_id AS representative_go_id, coalesce(j.jaccard, 0) AS jaccard_similarity, x.{OLD_COUNT} AS removed_genes_2016,
               x.{NEW_COUNT} AS removed_genes_2024, x.pct_change AS removed_pct_change, k.{OLD_COUNT} AS kept_genes_2016, k.{NEW_COUNT} AS kept_genes_2024, k.pct_change AS kept_pct_change
        FROM rows_ x JOIN kept k ON x.component = k.component AND x.go_id <> k.go_id
        LEFT JOIN j ON least(x.go_id, k.go_id) = j.a AND greatest(x.go_id, k.go_id) = j.b)"""


def _spearman(column: str) -> str:
    return f"""SELECT '{column}' AS measure, round(corr(rx, ry), 6) AS r, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY {GROWTH}) + (count(*) OVER (PARTITION BY {GROWTH}) - 1) / 2.0 AS ry FROM whole)"""


def _spearman_p(column: str) -> str:
    """The p value by the area under Student's density, put as a sum over 20,000 slices of the angle whose tangent is
    t / sqrt(freedom)."""
    return f"""SELECT measure, round(r, 6) AS r, round(greatest(1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * (
        SELECT sum(power(cos((i + 0.5) * asin(abs(r)) / 20000), n - 3)) * asin(abs(r)) / 20000 FROM range(20000) t(i)), 0), 6) AS p, n
        FROM (SELECT '{column}' AS measure, corr(rx, ry) AS r, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY {GROWTH}) + (count(*) OVER (PARTITION BY {GROWTH}) - 1) / 2.0 AS ry FROM whole))"""


def _dataset(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS dataset, count(*) AS n_terms, round(avg({OLD_COUNT}), 6) AS mean_genes, round(median({OLD_COUNT}), 6) AS median_genes,
        round(count(*) / CAST((SELECT nullif(count(*), 0) FROM dataset1) AS DOUBLE), 6) AS retention FROM dataset1 WHERE {where}"""


def _pair_counts(name: str, source: str) -> str:
    return f"SELECT '{name}' AS pairs, count(*) AS n_pairs, count(DISTINCT go_id) AS n_terms, count(DISTINCT entrez_gene_id) AS n_genes FROM {source}"


ORACLE_SQL = {
    "edge_list": f"WITH {_PAIRS} {_EDGES}",
    "term_frequency": f"WITH {_PAIRS} SELECT go_id, count(*) AS {OLD_COUNT} FROM old0 GROUP BY go_id",
    "term_sizes": f"WITH {_PAIRS} SELECT go_id, count(*) AS {NEW_COUNT} FROM new0 GROUP BY go_id",
    "term_size_band": f"WITH {_PAIRS} SELECT * FROM new0 WHERE go_id IN (SELECT go_id FROM new0 GROUP BY go_id HAVING count(*) BETWEEN 2 AND 12)",
    "universe_align": f"WITH {_ALIGNED} SELECT *, 'old' AS side FROM old UNION ALL SELECT *, 'new' FROM new",
    "parallel_explode": "SELECT p_brand AS go_id, p_brand AS go_name, p_partkey AS entrez_gene_id, p_name AS gene_symbol FROM part",
    "common_terms": f"WITH {_GROWTH} SELECT * FROM common",
    "stable_pairs": f"WITH {_GROWTH} SELECT go_id, entrez_gene_id FROM marked WHERE o = 1 AND n = 1",
    "added_pairs": f"WITH {_GROWTH} SELECT go_id, entrez_gene_id FROM marked WHERE o = 0",
    "removed_pairs": f"WITH {_GROWTH} SELECT go_id, entrez_gene_id FROM marked WHERE n = 0",
    "class_summary": f"""WITH {_GROWTH} SELECT *,
        round(100.0::DOUBLE * n_stable / greatest(n_genes_2024, 1), 6) AS pct_stable, round(100.0::DOUBLE * n_added / greatest(n_genes_2024, 1), 6) AS pct_added FROM summary""",
    "top_added": f"""WITH {_GROWTH}, top AS (SELECT * FROM summary ORDER BY n_added DESC, go_id LIMIT 10)
        SELECT go_id, p_name AS go_name, n_genes_2024, n_stable, n_added, round(100.0::DOUBLE * n_added / greatest(n_genes_2024, 1), 6) AS pct_added
        FROM top LEFT JOIN part ON go_id = CAST(p_partkey AS VARCHAR)""",
    "class_counts_join": f"WITH {_GROWTH} SELECT c.*, s.n_stable, s.n_added FROM common c LEFT JOIN summary s ON c.go_id = s.go_id",
    "pct_change": f"WITH {_GROWTH} SELECT {_SHOWN} FROM growth",
    "positive_growth": f"WITH {_GROWTH} SELECT {_SHOWN} FROM growing",
    "iqr_thresholds": f"""WITH {_GROWTH} SELECT round(g1 - 1.5 * (g3 - g1), 6) AS min_genes, round(g3 + 1.5 * (g3 - g1), 6) AS max_genes, round(g2, 6) AS median_genes,
        round(p1 - 1.5 * (p3 - p1), 6) AS min_pct_change, round(p3 + 1.5 * (p3 - p1), 6) AS max_pct_change, round(p2, 6) AS median_pct_change, total_terms FROM q""",
    "iqr_filtered": f"WITH {_GROWTH} SELECT {_SHOWN} FROM dataset1",
    "depths": f"WITH RECURSIVE {_OLD_TERMS} SELECT CAST(k AS VARCHAR) AS go_id, depth FROM depth2016",
    "norm_depths": f"WITH RECURSIVE {_NEW_TERMS} SELECT go_id, depth, max_depth, round(normalized_depth, 6) AS normalized_depth FROM norm2024",
    "hierarchy_metrics": f"""WITH RECURSIVE {_HIERARCHY} SELECT go_id, depth_2016, round(normalized_depth_2016, 6) AS normalized_depth_2016, depth_2024,
        round(normalized_depth_2024, 6) AS normalized_depth_2024, depth_change, round(norm_depth_change, 6) AS norm_depth_change FROM h""",
    "leaf_terms": f"WITH RECURSIVE {_NEW_TERMS} SELECT go_id FROM leaf2024",
    "leaf_parents": f"WITH RECURSIVE {_NEW_TERMS} SELECT go_id FROM above2024",
    "dataset_leaves": f"WITH RECURSIVE {_GROWTH}, {_NEW_TERMS} SELECT {_SHOWN} FROM dataset1 WHERE go_id IN (SELECT go_id FROM leaf2024)",
    "dataset_parents": f"WITH RECURSIVE {_GROWTH}, {_NEW_TERMS} SELECT {_SHOWN} FROM dataset1 WHERE go_id IN (SELECT go_id FROM above2024)",
    "spearman_depth_growth": f"WITH RECURSIVE {_HIERARCHY} " + " UNION ALL ".join(map(_spearman, snapshot.DEPTHS)),
    "depth_bins": f"""WITH RECURSIVE {_HIERARCHY}, b AS (
        SELECT CASE WHEN normalized_depth_2016 > 0 AND normalized_depth_2016 <= 0.33 THEN 'Shallow' WHEN normalized_depth_2016 > 0.33 AND normalized_depth_2016 <= 0.67 THEN 'Medium'
               WHEN normalized_depth_2016 > 0.67 AND normalized_depth_2016 <= 1 THEN 'Deep' END AS depth_bin_2016, {GROWTH} AS x FROM whole)
        SELECT depth_bin_2016, CASE depth_bin_2016 WHEN 'Shallow' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS bin_order, round(avg(x), 6) AS mean, round(median(x), 6) AS median, count(x) AS count
        FROM b WHERE depth_bin_2016 IS NOT NULL GROUP BY depth_bin_2016""",
    "describe_depth": f"""WITH RECURSIVE {_HIERARCHY}
        SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
        round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM (SELECT normalized_depth_2016 AS x FROM h)""",
    "hist_stable_30": f"""WITH {_GROWTH}, m AS (SELECT min(n_stable)::DOUBLE AS lo, max(n_stable)::DOUBLE AS hi FROM summary),
        p AS (SELECT least(CAST(floor((n_stable - lo) * 30 / (hi - lo)) AS INTEGER), 29) AS bin FROM summary, m)
        SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low, round(lo + (b + 1) * ((hi - lo) / 30), 6) AS high,
               (SELECT count(*) FROM p WHERE p.bin = b) AS count FROM range(30) t(b), m""",
    "growth_scatter": f"WITH {_GROWTH} SELECT n_stable, n_added FROM summary",
    "null_audit": f"WITH {_PAIRS} SELECT CAST(0 AS BIGINT) + count(*) FILTER (WHERE go_id IS NULL) + count(*) FILTER (WHERE entrez_gene_id IS NULL) AS nulls FROM old0",
    "quality_checks": f"""WITH {_PAIRS}, s AS (SELECT count(*) AS n_edges, count(*) FILTER (WHERE go_id IS NULL OR entrez_gene_id IS NULL) AS n_nulls,
        count(DISTINCT entrez_gene_id) AS n_genes, count(DISTINCT go_id) AS n_terms FROM old0)
        SELECT *, n_edges BETWEEN 20000 AND 40000 AS edges_ok, n_nulls = 0 AS nulls_ok, true AS columns_ok, n_genes >= 100 AS genes_ok, n_terms >= 1900 AS terms_ok FROM s""",
    "set_counts": f"""WITH {_PAIRS}, a AS (SELECT DISTINCT go_id FROM old0), b AS (SELECT DISTINCT go_id FROM new0), c AS (SELECT go_id FROM a INTERSECT SELECT go_id FROM b)
        SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM c) AS n_both,
               (SELECT count(*) FROM a) - (SELECT count(*) FROM c) AS n_only_a, (SELECT count(*) FROM b) - (SELECT count(*) FROM c) AS n_only_b""",
    "retention": f"""WITH {_GROWTH} SELECT (SELECT count(*) FROM growing) AS n_before, count(*) AS n_after, round(count(*) / CAST((SELECT count(*) FROM growing) AS DOUBLE), 6) AS share_kept,
        round(avg({OLD_COUNT}), 6) AS mean_genes, round(median({OLD_COUNT}), 6) AS median_genes FROM dataset1""",
    "jaccard_pairs": f"WITH RECURSIVE {_WORDS} SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard > 0.9",
    "components": f"WITH RECURSIVE {_WORDS} SELECT id, component FROM placed",
    "overlap_filtered": f"WITH RECURSIVE {_OVERLAP} SELECT go_id, {OLD_COUNT}, {NEW_COUNT} FROM kept",
    "overlap_removed": f"""WITH RECURSIVE {_OVERLAP} SELECT removed_go_id, representative_go_id, round(jaccard_similarity, 6) AS jaccard_similarity, removed_genes_2016, removed_genes_2024,
        round(removed_pct_change, 6) AS removed_pct_change, kept_genes_2016, kept_genes_2024, round(kept_pct_change, 6) AS kept_pct_change FROM removal""",
    "overlap_map": f"WITH RECURSIVE {_OVERLAP} SELECT removed_go_id, representative_go_id FROM removal",
    "cluster_sizes": f"WITH RECURSIVE {_OVERLAP} SELECT cluster_size, count(*) AS count FROM sizes GROUP BY cluster_size",
    "ontology_parse": """SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce((SELECT string_agg(DISTINCT CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR))
        FROM (SELECT unnest([p_partkey // 2, p_partkey // 3]) AS p) WHERE p > 0 AND p <> p_partkey), '') AS parents,
        CASE WHEN p_size <= 40 THEN 'biological_process' ELSE 'other' END AS namespace, p_size = 7 AS obsolete FROM part""",
    "csv_roundtrip": f"WITH {_GROWTH} SELECT * FROM common",
    "spearman_p_values": f"WITH RECURSIVE {_HIERARCHY} " + " UNION ALL ".join(map(_spearman_p, snapshot.DEPTHS)),
    "matrix_shape": "SELECT (SELECT count(*) FROM supplier) AS n_rows, (SELECT count(*) FROM part) AS n_cols",
    "pair_metrics": f"""WITH {_GROWTH} {_pair_counts('old', 'old')} UNION ALL {_pair_counts('new', 'new')} UNION ALL
        {_pair_counts('stable', '(SELECT * FROM marked WHERE o = 1 AND n = 1)')} UNION ALL {_pair_counts('added', '(SELECT * FROM marked WHERE o = 0)')}""",
    "class_metrics": f"""WITH {_GROWTH} SELECT count(*) AS n_terms, round(avg(n_genes_2016), 6) AS mean_n_genes_2016, round(avg(n_genes_2024), 6) AS mean_n_genes_2024,
        round(avg(n_stable), 6) AS mean_n_stable, round(avg(n_added), 6) AS mean_n_added, round(median(100.0::DOUBLE * n_stable / greatest(n_genes_2024, 1)), 6) AS median_pct_stable,
        round(median(100.0::DOUBLE * n_added / greatest(n_genes_2024, 1)), 6) AS median_pct_added FROM summary""",
    "dataset_metrics": f"""WITH RECURSIVE {_GROWTH}, {_NEW_TERMS} {_dataset('dataset1_all_growth', 'true')} UNION ALL
        {_dataset('dataset2_leaves', 'go_id IN (SELECT go_id FROM leaf2024)')} UNION ALL {_dataset('dataset2_parents', 'go_id IN (SELECT go_id FROM above2024)')}""",
    "nodes_roundtrip": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, CAST(p_partkey AS VARCHAR) AS identifier FROM part",
    "ids_roundtrip": f"WITH RECURSIVE {_NEW_TERMS} SELECT go_id FROM leaf2024",
    "cached_roundtrip": f"WITH RECURSIVE {_NEW_TERMS} SELECT go_id FROM leaf2024",
    "graph_roundtrip": f"WITH {_PAIRS} SELECT go_id, entrez_gene_id, p_name AS go_name FROM old0 JOIN part ON go_id = CAST(p_partkey AS VARCHAR)",
    "graph_documents": f"WITH {_PAIRS} SELECT go_id, entrez_gene_id, p_name AS go_name FROM old0 JOIN part ON go_id = CAST(p_partkey AS VARCHAR)",
}
