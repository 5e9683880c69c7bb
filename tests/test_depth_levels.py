"""A level of the traversal takes only the terms that it reaches first, however many ways lead to a term."""

import random

from termdrift.operators import ontology


def test_a_term_reached_again_goes_no_further(spark):
    links = spark.createDataFrame([("", p, c) for p, c in [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b")]], "snapshot string, parent string, child string")
    at, seen = spark.createDataFrame([("", "a", 0)], "snapshot string, go_id string, depth int"), []
    for level in range(1, 5):
        at = ontology.one_level(at, links, level)
        seen.append({r["go_id"]: r["depth"] for r in at.collect()})
    assert seen == [{"a": 0, "b": 1, "c": 1}] + 3 * [{"a": 0, "b": 1, "c": 1, "d": 2}]
    assert at.count() == 4


def test_depths_over_many_jobs_and_ways(spark):
    rng = random.Random(4)
    parents = {k: sorted({rng.randrange(max(0, k - 9), k) for _ in range(rng.randrange(1, 4))}) if k > 5 and rng.random() > 0.05 else [] for k in range(300)}
    terms = spark.createDataFrame([(str(k), [str(p) for p in up], ontology.PROCESS, False) for k, up in parents.items()], "id string, parents array<string>, namespace string, obsolete boolean")
    want = {}
    for k, up in parents.items():  # parents come before their children
        want[k] = 1 + min(want[p] for p in up) if up else 0
    found, deepest = ontology.all_depths({"x": terms}, levels=1, most=3)
    assert {int(r["go_id"]): r["depth"] for r in found.collect()} == want and found.count() == 300
    assert deepest == {"x": max(want.values())} and deepest["x"] > 6
