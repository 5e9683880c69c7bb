"""From the files of two snapshots to the written datasets, and what the report says of them."""

import bz2
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termdrift.operators import classify, universe
from termdrift.plans import snapshot
from termdrift.sources import files

GENES, TERMS = list(range(101, 141)), [f"T{k}" for k in range(12)]


def held(k: int) -> range:
    """The genes of a term in the old snapshot: so many that fences and sizes part them."""
    return range(0, 10 + 2 * k)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    cells = [(g, t) for t in range(12) for g in held(t)]
    rows, cols = map(np.array, zip(*cells, strict=True))
    np.savez(at / "edges.npz", row=rows, col=cols, data=np.ones(len(cells), bool), format=np.array("coo"), shape=np.array([40, 12]))
    (at / "genes.tsv").write_text("position\tidentifier\tname\n" + "".join(f"{k}\t{g}\tg{g}\n" for k, g in enumerate(GENES)))
    (at / "terms.tsv").write_text("identifier\tname\r\n" + "".join(f"{t}\tthe {t}\r\n" for t in TERMS))
    lines = ["go_id\tgo_name\tgo_domain\tgene_ids\tgene_symbols"]
    for k, t in enumerate(TERMS):
        own = [GENES[g] for g in held(k) if g != 1] + [GENES[31 - g] for g in range(k % 4 + 1)]
        own = sorted(set(own)) + [999]  # a gene the old snapshot does not know
        lines.append(f"{t}\tthe {t}\tbiological_process\t...|{'|'.join(map(str, own))}\t...|{'|'.join(f's{g}' for g in own)}")
    lines.append("X\tother\tmolecular_function\t101|102\ta|b")
    (at / "annotations.tsv").write_text("\n".join(lines) + "\n")
    old, new = snapshot.load_pairs(spark, str(at / "edges.npz"), str(at / "genes.tsv"), str(at / "terms.tsv"), str(at / "annotations.tsv"), {"edges": (1, 1000), "genes": 10, "terms": 12})
    return at, snapshot.compare(old, new)


@pytest.fixture(scope="module")
def terms(spark):
    up = {t: [f"T{(k - 1) // 2}"] if k else [] for k, t in enumerate(TERMS)}
    return spark.createDataFrame([(t, p, "biological_process", False) for t, p in up.items()], "id string, parents array<string>, namespace string, obsolete boolean")


def expected():
    old = {(t, GENES[g]) for k, t in enumerate(TERMS) for g in held(k)}
    new = {(t, GENES[g]) for k, t in enumerate(TERMS) for g in held(k) if g != 1} | {(t, GENES[31 - g]) for k, t in enumerate(TERMS) for g in range(k % 4 + 1)}
    known = {g for _, g in old}
    new = {(t, g) for t, g in new if g in known}
    left = {g for _, g in new}
    return {(t, g) for t, g in old if g in left}, new


def test_pairs_and_classes(found):
    old, new = expected()
    pairs = lambda df: {(r["go_id"], r["entrez_gene_id"]) for r in df.collect()}
    assert pairs(found[1].old_pairs) == old and pairs(found[1].new_pairs) == new
    assert pairs(found[1].stable) == old & new and pairs(found[1].added) == new - old
    counts = {r["pairs"]: (r["n_pairs"], r["n_terms"], r["n_genes"]) for r in snapshot.pair_metrics(found[1]).collect()}
    want = {"old": old, "new": new, "stable": old & new, "added": new - old}
    assert counts == {k: (len(v), len({t for t, _ in v}), len({g for _, g in v})) for k, v in want.items()}
    m = snapshot.class_metrics(found[1]).first()
    assert m["n_terms"] == 12 and m["mean_n_stable"] == pytest.approx(len(old & new) / 12)


def test_datasets_levels_and_their_files(spark, found, terms, tmp_path):
    old, new = expected()
    n = lambda side, t: sum(x == t for x, _ in side)
    change = {t: (n(new, t) - n(old, t)) / n(old, t) for t in TERMS}
    growing = [t for t in TERMS if change[t] > 0]

    def fence(values):
        low, high = np.quantile(values, [0.25, 0.75])
        return low - 1.5 * (high - low), high + 1.5 * (high - low)

    size, pct = fence([n(old, t) for t in growing]), fence([change[t] for t in growing])
    want = {t for t in growing if n(old, t) >= 10 and size[0] <= n(old, t) <= size[1] and pct[0] <= change[t] <= pct[1]}
    assert {r["go_id"] for r in found[1].dataset1_all_growth.collect()} == want and want
    leaves = {t for k, t in enumerate(TERMS) if 2 * k + 1 >= 12}
    above = {f"T{(int(t[1:]) - 1) // 2}" for t in leaves}
    snapshot.write_datasets(found[1], terms, str(tmp_path))
    back = files.read_table(spark, str(tmp_path / "dataset2_levels"), "go_id string, level string").collect()
    assert {tuple(r) for r in back} == {(t, "leaf") for t in want & leaves} | {(t, "parent") for t in want & above}
    assert files.read_table(spark, str(tmp_path / "old_pairs"), "go_id string, entrez_gene_id long").count() == len(old)
    m = {r["dataset"]: r for r in snapshot.dataset_metrics(found[1], terms).collect()}
    assert m["dataset1_all_growth"]["n_terms"] == len(want) and m["dataset2_leaves"]["retention"] == pytest.approx(len(want & leaves) / len(want))


def test_pairs_meet_without_a_shuffle_by_pair(found):
    c = found[1]
    for df in (c.stable, c.added, c.removed, classify.pair_classes(c.old_pairs, c.new_pairs)):
        assert "hashpartitioning(go_id" not in df._jdf.queryExecution().executedPlan().toString()
    terms = classify.by_term(classify.pair_classes(c.old_pairs, c.new_pairs))._jdf.queryExecution().executedPlan().toString()
    assert terms.count("Exchange hashpartitioning(go_id#") == 1


def test_rows_that_repeat_and_missing_ends(spark):
    kind = "go_id string, entrez_gene_id long"
    old = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("A", 3), ("B", None), (None, 1), ("C", 9)], kind)
    new = spark.createDataFrame([("A", 2), ("A", 3), ("A", 4), ("A", 4), ("B", None), (None, 1), ("D", 7)], kind)
    got = {(r["go_id"], r["entrez_gene_id"], r["n_old"], r["n_new"]) for r in classify.pair_classes(old, new).collect()}
    apart = {("B", None, 1, 0), ("B", None, 0, 1), (None, 1, 1, 0), (None, 1, 0, 1)}
    assert got == {("A", 1, 1, 0), ("A", 2, 2, 1), ("A", 3, 1, 1), ("A", 4, 0, 2), ("C", 9, 1, 0), ("D", 7, 0, 1)} | apart
    by = {r["go_id"]: r for r in classify.by_term(classify.pair_classes(old, new)).collect()}
    assert (by["A"]["rows_stable"], by["A"]["rows_added"], by["A"]["n_stable"], by["A"]["n_added"]) == (3, 2, 2, 1)
    assert (by["B"]["n_genes_2016"], by["B"]["rows_added"]) == (0, 1)


def test_the_whole_analysis(spark, found, tmp_path):
    at, compared = found
    stanza = lambda k, t: f"[Term]\nid: {t}\nnamespace: biological_process\n" + (f"is_a: T{(k - 1) // 2} ! up\n" if k else "")
    text = "format-version: 1.2\n\n" + "\n".join(stanza(k, t) for k, t in enumerate(TERMS))
    for name in ("old.obo", "new.obo"):
        (tmp_path / name).write_text(text)
    paths = [str(at / f) for f in ("edges.npz", "genes.tsv", "terms.tsv", "annotations.tsv")]
    folder = str(tmp_path / "out")
    snapshot.analyse(spark, *paths, (str(tmp_path / "old.obo"), str(tmp_path / "new.obo")), folder, {"edges": (1, 1000), "genes": 10, "terms": 12})
    rows = files.read_table(spark, f"{folder}/common_terms", "go_id string, pct_change_genes double, depth_2016 int, normalized_depth_2024 double, norm_depth_change double").collect()
    assert {r["go_id"]: r["depth_2016"] for r in rows} == {t: int(math.log2(k + 1)) for k, t in enumerate(TERMS)}
    assert all(r["normalized_depth_2024"] == r["depth_2016"] / 3 and r["norm_depth_change"] == 0 for r in rows)
    assert {r["go_id"] for r in files.read_table(spark, f"{folder}/dataset1_all_growth", "go_id string, depth_2024 int").collect()} == {r["go_id"] for r in compared.dataset1_all_growth.collect()}
    report = lambda name, schema: files.read_table(spark, f"{folder}/report/{name}", schema).collect()
    assert {r["pairs"] for r in report("pair_metrics", "pairs string, n_pairs long")} == {"old", "new", "stable", "added"}
    assert [r["measure"] for r in report("depth_correlations", "measure string, r double, p double, n long")] == list(snapshot.DEPTHS)
    assert len(report("top_added", "go_id string, go_name string")) == 10 and len(report("stable_histogram", "bin int, count long")) == 30
    with pytest.raises(ValueError, match="edges_ok"):
        snapshot.load_pairs(spark, *paths, {"edges": (1, 2), "genes": 10, "terms": 12})


def test_depth_analysis_gives_p_values(spark):
    rows = [(f"t{i}", 0.1 + i % 7 / 10, 0.1 + i % 5 / 10, (i % 5 - i % 7) / 10, math.sin(i)) for i in range(40)]
    h = spark.createDataFrame([*rows, ("gap", None, 0.5, None, 1.0)], "go_id string, normalized_depth_2016 double, normalized_depth_2024 double, norm_depth_change double, pct_change_genes double")
    tests = {r["measure"]: r for r in snapshot.depth_correlations(h).collect()}
    for k, name in enumerate(snapshot.DEPTHS, 1):
        rank = lambda v: np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])
        r = np.corrcoef(rank([x[k] for x in rows]), rank([x[4] for x in rows]))[0, 1]
        angle = math.asin(abs(r))
        u = (np.arange(20000) + 0.5) * angle / 20000
        p = 1 - 2 * math.exp(math.lgamma(39 / 2) - math.lgamma(38 / 2)) / math.sqrt(math.pi) * (np.cos(u) ** 37).sum() * angle / 20000
        assert tests[name]["r"] == pytest.approx(r) and tests[name]["n"] == 40 and tests[name]["p"] == pytest.approx(p, abs=1e-6)
    assert sum(b["count"] for b in snapshot.growth_by_depth(h).collect()) == 40
    assert [(r["r"], r["p"], r["n"]) for r in snapshot.depth_correlations(h.where("false")).collect()] == [(None, None, 0)] * 3
    assert snapshot.growth_by_depth(h.where("false")).count() == 0


def test_what_is_wrong_is_an_error(spark, found):
    at = found[0]
    with pytest.raises(RuntimeError, match="cannot be read"):
        files.read_table(spark, str(at / "absent.tsv"), "a string", sep="\t")
    with pytest.raises(RuntimeError, match="lacks"):
        files.read_table(spark, str(at / "annotations.tsv"), "absent string", sep="\t")
    with pytest.raises(ValueError, match="genes_ok"):
        snapshot.load_pairs(spark, str(at / "edges.npz"), str(at / "genes.tsv"), str(at / "terms.tsv"), str(at / "annotations.tsv"), {"edges": (1, 1000), "genes": 41, "terms": 12})


def test_graph_document(spark, tmp_path):
    nodes = [{"kind": "Gene", "identifier": "1", "name": "a"}, {"kind": "Process", "identifier": "T", "name": "b"}]
    edges = [{"source_id": ["Gene", "1"], "target_id": ["Process", "T"], "kind": "participates", "direction": "both"}]
    (tmp_path / "graph.json.bz2").write_bytes(bz2.compress(json.dumps({"nodes": nodes, "edges": edges}).encode()))
    got_nodes, got_edges = files.read_graph(spark, str(tmp_path / "graph.json.bz2"))
    files.write_graph(got_nodes, got_edges, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/nodes"))
    assert {(r["kind"], r["identifier"], r["name"]) for r in back.collect()} == {("Gene", "1", "a"), ("Process", "T", "b")}
    edge = spark.read.parquet(str(tmp_path / "out/edges")).first()
    assert (edge["metaedge"], edge["source"], edge["target"], edge["direction"]) == ("participates", ["Gene", "1"], ["Process", "T"], "both")


def test_matrix_layouts_and_shape(spark, tmp_path):
    data = dict(format=np.array("csc"), shape=np.array([3, 2]), data=np.array([True, True, False]), indices=np.array([2, 0, 1]), indptr=np.array([0, 1, 3]))
    np.savez(tmp_path / "m.npz", **data)
    assert sorted(map(tuple, files.read_matrix(spark, str(tmp_path / "m.npz")).collect())) == [(0, 1, 1.0), (1, 1, 0.0), (2, 0, 1.0)]
    one = spark.range(3).withColumn("x", F.lit(1))
    assert tuple(universe.matrix_shape(one, one.limit(2)).first()) == (3, 2)


def test_equal_sets_are_compared_once(spark):
    from termdrift.operators import overlap

    sets = {1: "abcd", 2: "abcd", 3: "abcde", 9: "abcd", 4: "xyz"}
    items = spark.createDataFrame([(k, c) for k, s in sets.items() for c in s], "id long, item string")
    pairs, twins = overlap.jaccard_links(items, 0.5)
    assert [tuple(r) for r in pairs.collect()] == [(1, 3, 0.8)]
    assert {tuple(r) for r in twins.collect()} == {(1, 1), (2, 1), (9, 1), (3, 3), (4, 4)}
    assert {(r["a"], r["b"], r["jaccard"]) for r in overlap.jaccard_pairs(items, 0.5).collect()} == {(1, 2, 1.0), (1, 9, 1.0), (2, 9, 1.0), (1, 3, 0.8), (2, 3, 0.8), (3, 9, 0.8)}
    placed = overlap.clusters(items.select("id"), overlap.cluster_links(pairs, twins), 0.75)
    assert {tuple(r) for r in placed.collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4)}
