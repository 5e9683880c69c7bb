"""The similarity that is reported at the far end of a chain of links."""

import pytest

from termdrift.operators import overlap
from termdrift.plans import queries
from termdrift.schemas import NEW_COUNT, OLD_COUNT


def test_a_chain_reports_the_true_similarity(spark):
    sets = {1: range(100), 2: range(5, 105), 3: range(10, 110)}  # 95/105 between neighbours, 90/110 between the ends
    items = spark.createDataFrame([(k, str(i)) for k, s in sets.items() for i in s], "id long, item string")
    data = spark.createDataFrame([(1, 10, 100), (2, 10, 20), (3, 10, 12)], f"go_id long, {OLD_COUNT} long, {NEW_COUNT} long")
    pairs = overlap.jaccard_pairs(items, 0.85)
    got = overlap.filter_overlapping_go_terms(items.select("id"), pairs, data, memberships=items).removal.collect()
    assert {(r["removed_go_id"], r["representative_go_id"]): r["jaccard_similarity"] for r in got} == {(2, 1): pytest.approx(95 / 105), (3, 1): pytest.approx(90 / 110)}


def test_the_query_reports_it_too(spark, tmp_path):
    texts = {1: range(100), 2: range(5, 105), 3: range(10, 110)}
    rows = [(k, " ".join(map(str, s)), 1000 // k) for k, s in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["removed_go_id"]: r["jaccard_similarity"] for r in queries.overlap_removed(spark, str(tmp_path)).collect()}
    assert got == {2: round(95 / 105, 6), 3: round(90 / 110, 6)}
