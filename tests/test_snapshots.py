"""Golden micro-fixtures, one per trap."""

import math

import pytest
from pyspark.sql import functions as F

from termdrift.functions import scalars, stats
from termdrift.operators import classify, growth, ontology, overlap, universe
from termdrift.operators.components import connected_components
from termdrift.schemas import NEW_COUNT, OLD_COUNT
from termdrift.sources import files

TERMS = [
    ("T:1", "bp", "", ""), ("T:2", "bp", "T:1", ""), ("T:3", "bp", "T:1", ""), ("T:4", "bp", "T:2 T:1", ""),
    ("T:5", "bp", "T:4", ""), ("T:6", "bp", "T:1", "is_obsolete: false"), ("T:7", "cc", "", ""), ("T:8", "bp", "T:7", "alt_id: T:88"), ("T:9", "bp", "T:6", ""), ("T:10", "bp", "T:5", ""),
]


def obo() -> str:
    out = ["id: HEADER", ""]
    for i, space, parents, other in TERMS:
        out += ["[Term]", f"id: {i}", f"namespace: {space}", *[f"is_a: {p} ! name" for p in parents.split()], other, ""]
    return "\n".join([*out, "[Typedef]", "id: part_of", "namespace: external", "is_a: overlaps", ""])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("mode", "depth", "leaves", "parents"), [
    ("compat", {"T:1": 0, "T:2": 1, "T:3": 1, "T:4": 1, "T:5": 2, "T:8": 0, "T:9": 0}, {"T:3", "T:5", "T:8", "T:9"}, {"T:1", "T:4"}),
    ("strict", {"T:1": 0, "T:2": 1, "T:3": 1, "T:4": 1, "T:5": 2, "T:8": 0, "T:9": 0, "T:10": 3}, {"T:3", "T:8", "T:9", "T:10"}, {"T:1", "T:5"}),
])
def test_ontology(spark, tmp_path, mode, depth, leaves, parents):
    (tmp_path / "x.obo").write_text(obo())
    terms = files.read_ontology(spark, str(tmp_path / "x.obo"), mode).cache()
    assert dict(rows(ontology.depths(terms, "bp"))) == depth
    found = ontology.identify_leaf_terms(terms, "bp")
    assert {r[0] for r in rows(found)} == leaves
    assert {r[0] for r in rows(ontology.identify_parent_terms(found, terms, "bp"))} == parents
    share = {r["go_id"]: r["normalized_depth"] for r in ontology.normalised_depths(terms, "bp").collect()}
    assert share["T:5"] == 2 / max(depth.values()) and share["T:1"] == 0


def test_cycle_has_no_depth(spark):
    terms = spark.createDataFrame([("a", ["b"], "bp", False), ("b", ["a"], "bp", False), ("r", [], "bp", False)], "id string, parents array<string>, namespace string, obsolete boolean")
    assert rows(ontology.depths(terms, "bp")) == [("r", 0)]
    assert rows(ontology.normalised_depths(terms, "none")) == []


def test_classification(spark):
    old = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 9)], "go_id string, entrez_gene_id long")
    new = spark.createDataFrame([("A", 2), ("A", 3), ("A", 4), ("A", 4), ("B", 5), ("D", 7)], "go_id string, entrez_gene_id long")
    stable, added, summary = classify.classify_genes_stable_added(old, new)
    assert rows(stable) == [("A", 2), ("A", 3)]
    assert rows(added) == [("A", 4), ("A", 4), ("B", 5), ("D", 7)]
    got = {r[0]: tuple(round(x, 6) for x in r[1:]) for r in rows(summary)}
    assert got == {"A": (3, 3, 2, 1, 1, 66.666667, 33.333333), "B": (1, 1, 0, 1, 1, 0, 100), "C": (1, 0, 0, 0, 1, 0, 0), "D": (0, 1, 0, 1, 0, 0, 100)}
    names = new.withColumn("go_name", F.lower("go_id"))
    assert {r["go_id"] for r in classify.top_added(summary, names, 2).collect()} == {"A", "B"}


def test_fences(spark):
    some = [("A", 5, 10), ("B", 10, 15), ("C", 12, 18), ("D", 14, 15), ("E", 20, 30), ("F", 22, 25), ("G", 24, 26), ("H", 200, 420)]
    counts = spark.createDataFrame(some, f"go_id string, {OLD_COUNT} long, {NEW_COUNT} long")
    grown = growth.positive_growth(growth.calculate_percent_change(counts))
    fences = growth.calculate_iqr_thresholds(grown)
    t = fences.first()
    assert (t["min_genes"], t["max_genes"], t["median_genes"], t["total_terms"]) == (-5, 39, 17, 8)
    assert t["min_pct_change"] == pytest.approx(-0.6297348485) and t["max_pct_change"] == pytest.approx(1.3778409091)
    assert [r["go_id"] for r in growth.filter_go_terms_iqr(grown, fences).orderBy("go_id").collect()] == list("BCDEFG")


def test_overlap(spark):
    nodes = spark.createDataFrame([(f"G{i}",) for i in range(1, 7)], "id string")
    sims = spark.createDataFrame([("G1", "G2", 0.95), ("G2", "G3", 0.92), ("G1", "G3", 0.85), ("G4", "G5", 0.90)], "a string, b string, jaccard double")
    data = spark.createDataFrame([("G1", 10, 20), ("G2", 10, 0), ("G3", 10, 15), ("G4", 10, 11), ("G5", 10, 12), ("G6", 10, 13), ("X", 1, 2)], f"go_id string, {OLD_COUNT} long, {NEW_COUNT} long")
    got = overlap.filter_overlapping_go_terms(nodes, sims, data)
    assert [r[0] for r in rows(got.filtered)] == ["G1", "G4", "G5", "G6"]
    assert rows(got.removed_terms) == [("G2", "G1"), ("G3", "G1")]
    assert rows(got.removal) == [("G2", "G1", 0.95, 10, 0, 100.0, 10, 20, 100.0), ("G3", "G1", 0.85, 10, 15, 50.0, 10, 20, 100.0)]
    assert rows(got.cluster_stats) == [(1, 3), (3, 1)]
    none = overlap.filter_overlapping_go_terms(nodes, sims.where("false"), data)
    assert none.removal.count() == 0 and len(none.removal.columns) == 9


def test_long_path(spark):
    edges = spark.range(63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert rows(connected_components(edges)) == [(i, 0) for i in range(64)]
    assert connected_components(edges.where("false")).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.split_list(F.lit("1|2|"))) == ["1", "2", ""]
    assert one(scalars.strip(F.lit("\t a \r"))) == "a" and one(scalars.strip(F.lit("five "))) == "five"
    assert [one(scalars.depth_bin(F.lit(x))) for x in (0.0, 0.33, 0.331, 0.67, 1.0)] == [None, "Shallow", "Medium", "Medium", "Deep"]
    assert one(scalars.relative_change(F.lit(0), F.lit(5))) == math.inf and one(scalars.relative_change(F.lit(0), F.lit(0))) is None
    assert one(scalars.na_to_null(F.lit("NA"))) is None


def test_statistics(spark):
    d = stats.describe(spark.createDataFrame([(float(x),) for x in (3, 1, 4, 1, 5, 9, 2, 6)], "x double"), "x").first()
    assert (d["p25"], d["p50"], d["p75"]) == (1.75, 3.5, 5.25) and d["std"] == pytest.approx(2.748376143938713)
    h = stats.histogram(spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 10)], "x int"), "x", 3).orderBy("bin").collect()
    assert [(r["low"], r["high"], r["count"]) for r in h] == [(1, 4, 4), (4, 7, 0), (7, 10, 1)]
    xy = spark.createDataFrame(list(zip((1, 2, 2, 3, 5, 8, 8, 1), (2, 1, 4, 4, 6, 5, 9, 0), strict=True)), "x int, y int")
    got = stats.rank_correlations(xy.withColumn("z", F.lit(1)), ["x", "z"], "y").collect()
    assert got[0]["r"] == pytest.approx(0.8842120943613945) and got[1]["r"] is None and got[1]["p"] is None


def test_explode(spark):
    make = lambda i, s: spark.createDataFrame([("t", "n", "biological_process", i, s)], "go_id string, go_name string, go_domain string, gene_ids string, gene_symbols string")
    assert rows(universe.of_domain(universe.exploded(make("...|1| 2\t", "...|a|b ")))) == [("t", "n", 1, "a"), ("t", "n", 2, "b")]
    for i, s in (("1|2", "a"), (None, None), ("x", "a")):
        with pytest.raises(Exception):  # noqa: B017
            universe.exploded(make(i, s)).collect()


def test_universe(spark):
    old = [("one", 0), ("band", 1), ("band", 2), ("gone", 99)] + [("big", g) for g in range(1000)] + [("huge", g) for g in range(1000)]
    new = [("one", 0), ("band", 1), ("band", 2), ("band", 5000), ("fresh", 1), ("fresh", 2)] + [("big", g) for g in range(99)] + [("big", g) for g in range(100, 1000)] + [("huge", 1), ("huge", 5001)]
    kind = "go_id string, entrez_gene_id long"
    a, b = universe.align(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    assert {r[0]: r[1] for r in b.groupBy("go_id").count().collect()} == {"band": 2, "big": 999}
    assert "gone" not in {r[0] for r in universe.common_terms(a, b).collect()} and a.where("entrez_gene_id = 99").count() == 0
    again = universe.size_band(universe.within(b, a, "entrez_gene_id"))
    assert rows(again) == rows(b)


def test_files(spark, tmp_path):
    import numpy as np

    df = spark.createDataFrame([("GO:1", 'a, "q" b', 3, None), ("GO:2", "NA", 4, "s")], "go_id string, go_name string, entrez_gene_id long, gene_symbol string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_table(spark, str(tmp_path / "c"), "go_id string, go_name string, entrez_gene_id long")
    assert rows(back.select("go_id", "entrez_gene_id", F.coalesce("go_name", F.lit("-")))) == [("GO:1", 3, 'a, "q" b'), ("GO:2", 4, "-")]
    files.write_ids(df.select("go_id"), str(tmp_path / "i"))
    assert rows(files.read_ids(spark, str(tmp_path / "i"))) == [("GO:1",), ("GO:2",)]
    np.savez(tmp_path / "m.npz", indices=np.array([1, 0, 2]), indptr=np.array([0, 1, 3]), format=np.array(b"csr"), shape=np.array([2, 3]), data=np.array([1, 0, 2]))
    assert rows(files.read_matrix(spark, str(tmp_path / "m.npz"))) == [(0, 1, 1.0), (1, 0, 0.0), (1, 2, 2.0)]
    (tmp_path / "n.tsv").write_text("identifier\tname\n7\tx\n3\ty\n")
    assert rows(files.read_nodes(spark, str(tmp_path / "n.tsv"), "long")) == [(0, 7), (1, 3)]
    calls = []
    for source in ("v1", "v1", "v2"):
        files.cached(spark, str(tmp_path / "k"), "t", [source], lambda: calls.append(1) or df)
    assert len(calls) == 2
