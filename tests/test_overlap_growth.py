"""What the join of sets compares grows with the table where rare items recur in unlike sets, and no pair is lost."""

import random

import pytest
from pyspark.sql import functions as F

from termdrift.operators import overlap


def planted(n, seed=5):
    """Unlike sets out of one vocabulary, so that every item recurs, and some near copies of every tenth."""
    rng, sets = random.Random(seed), {}
    for k in range(n):
        sets[k] = set(rng.sample(range(300), rng.randrange(40, 90)))
    for k in range(0, n, 10):
        for c in range(1, 4):
            near = set(sets[k])
            for x in rng.sample(sorted(near), c):
                near.remove(x)
            sets[n + 10 * k + c] = near | {1000 + c}
    return sets


def test_few_unlike_sets_meet_and_all_links_are_found(spark, monkeypatch):
    sets = planted(400)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    items = spark.createDataFrame([(k, str(x)) for k, s in sets.items() for x in s], "id long, item string")
    close = {p: j for p, j in want.items() if j >= 0.85}
    assert len(close) <= overlap.candidate_pairs(overlap.ordered_sets(items), 0.85).count() < 4 * len(close)
    monkeypatch.setattr(overlap, "BLOCK", 2)  # components of several blocks
    got = {(r["a"], r["b"]): r["jaccard"] for r in overlap.jaccard_pairs(items, 0.85).collect()}
    assert got == {p: pytest.approx(j) for p, j in close.items()}
    stored = overlap.stored_sets(overlap.item_sets(items))
    placed = overlap.clusters(items.select("id"), overlap.set_cluster_links(stored, 0.9))
    component = {k: k for k in sets}
    for _ in range(8):
        for (a, b), j in want.items():
            if j > 0.9:
                component[a] = component[b] = min(component[a], component[b])
    assert {r["id"]: r["component"] for r in placed.collect()} == component


def test_large_unlike_sets_are_told_apart_by_their_bits(spark):
    """Two sets of 1500 items, of which half are common, differ in more items than 256 bits can show."""
    sets = {k: set(range(750)) | set(range(1000 * (k + 1), 1000 * (k + 1) + 750)) for k in range(12)}
    sets[12] = set(range(750)) | set(range(1000, 1700))  # 1450 of the 1500 of the first
    rows = [(k, len(s), [str(x) for x in s]) for k, s in sets.items()]
    given = spark.createDataFrame(rows, "k long, n int, items array<string>")
    pairs = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b], "a long, b long, m int, n int")
    got = overlap.likely(pairs, overlap.parity_bits(given), 0.85).collect()
    assert [(r["a"], r["b"]) for r in got] == [(0, 12)]


@pytest.mark.parametrize("at_least", [0.3, 0.85])
def test_bits_leave_out_no_pair_whatever_the_widths(spark, at_least):
    rng = random.Random(3)
    sets = {0: set(range(1100))}
    for k in range(1, 60):  # sizes on both sides of powers of two
        sets[k] = set(rng.sample(range(1100), 180 + 15 * k))
    for k in range(60, 70):
        sets[k] = set(range(k)) if k % 2 else set(range(1100 - 3 * k))
    given = spark.createDataFrame([(k, len(s), [str(x) for x in s]) for k, s in sets.items()], "k long, n int, items array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b])}
    pairs = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b], "a long, b long, m int, n int")
    assert want <= {(r["a"], r["b"]) for r in overlap.likely(pairs, overlap.parity_bits(given), at_least).collect()}
    assert want <= {(r["a"], r["b"]) for r in overlap.candidate_pairs(given, at_least).collect()}


def test_a_pair_that_shares_one_signature_does_not_meet(spark):
    """Of 400 sets out of one vocabulary many share a signature by chance, few two."""
    sets = {k: v for k, v in planted(400).items() if k < 400}
    given = overlap.sized(spark.createDataFrame([(k, [str(x) for x in s]) for k, s in sets.items()], "id long, items array<string>"))
    posted = overlap.shared_postings(given, 0.85).toPandas()
    once = {(a, b) for _, g in posted.groupby("s") for a in g["k"] for b in g["k"] if a < b}
    assert overlap.met_pairs(overlap.shared_postings(given, 0.85), 0.85).count() < len(once) / 4


def test_sets_of_repeated_ids_are_one(spark, tmp_path):
    from termdrift.plans import queries

    rows = [(1, "a b  c", 5), (1, "c d", 3), (2, "a b c d", 7), (3, " ", 1), (4, None, 0), (None, "a b c d", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.words(spark, str(tmp_path)).select("id", F.array_sort("items").alias("items")).collect()
    assert {r["id"]: r["items"] for r in got} == {1: list("abcd"), 2: list("abcd")}
    assert [tuple(r) for r in queries.jaccard_pairs(spark, str(tmp_path)).collect()] == [(1, 2, 1.0)]
