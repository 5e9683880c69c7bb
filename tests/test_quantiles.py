"""Quantiles and ranks by ranges of values, the t distribution, and depths of many ontologies, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termdrift.functions import quantiles, stats
from termdrift.operators import growth, ontology


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.gauss(0, 5), float(rng.randrange(6)), None if i % 7 else 1.5) for i in range(5000)]
    rows += [("a", float("nan"), 3.0, None), (None, None, None, None), ("only", 2.5, 1.0, None), ("c", float("inf"), 0.0, None), ("c", float("-inf"), 0.0, None)]
    return spark.createDataFrame(rows, "g string, x double, ties double, rare double").repartition(7)


def known(rows, c, g=None):
    return sorted(r[c] for r in rows if r[c] is not None and not math.isnan(r[c]) and (g is None or r["g"] == g))


def interpolated(values, share):
    at = share * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low * (1 - at % 1) + high * (at % 1)


def test_quantiles_of_all_columns_in_one_pass(table):
    rows, shares = table.collect(), (0.0, 0.1, 0.25, 0.5, 0.5, 0.999, 1.0)
    got = {r["series"]: r for r in quantiles.quantiles(quantiles.stacked(table, ["x", "ties", "rare"]), shares).collect()}
    assert got.keys() == {"x", "ties", "rare"}
    for c, r in got.items():
        values = known(rows, c)
        assert r["n"] == len(values) and r["q"] == pytest.approx([interpolated(values, s) for s in shares], rel=1e-12)
    by = {(r["series"]["column"], r["series"]["group"]): r["q"] for r in quantiles.quantiles(quantiles.stacked(table, ["x", "rare"], by="g"), [0.5]).collect()}
    for (c, g), q in by.items():
        assert q == pytest.approx([interpolated(known(rows, c, g or ""), 0.5)]) if g else True
    assert ("x", "only") in by and ("rare", "only") not in by


def test_no_task_holds_more_than_a_range(spark, table):
    counted, sums = quantiles.ranges(quantiles.stacked(table, ["x", "ties"]))
    sizes = [r["count"] for r in counted.groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.6 * sum(sizes)
    assert sums.agg(F.sum("inside")).first()[0] == len(known(table.collect(), "x")) + len(known(table.collect(), "ties"))
    plan = quantiles.quantiles(quantiles.stacked(table, ["x"]))._jdf.queryExecution().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("Window")[0]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "x double, g string")
    assert quantiles.quantiles(quantiles.stacked(empty, ["x"])).count() == 0
    assert stats.describe(empty, "x").first().asDict() == {"count": 0, **dict.fromkeys(("mean", "std", "min", "p25", "p50", "p75", "max"))}
    one = spark.createDataFrame([(7.0, "g")], "x double, g string")
    d = stats.describe(one, "x").first()
    assert (d["p25"], d["p50"], d["p75"], d["std"]) == (7, 7, 7, None)
    fences = growth.calculate_iqr_thresholds(spark.createDataFrame([], "no_of_genes_in_hetio_GO_2016 long, pct_change_genes double")).first()
    assert fences["total_terms"] == 0 and fences["min_genes"] is None
    assert [tuple(r) for r in stats.by_bin(one, "g", "x").collect()] == [("g", 7.0, 7.0, 1)]


def test_average_ranks(table):
    got = {(r["series"], r["value"]): r["rank"] for r in quantiles.average_ranks(quantiles.stacked(table, ["x", "ties"])).collect()}
    rows = table.collect()
    for c in ("x", "ties"):
        values = np.array(known(rows, c))
        for v in set(values.tolist()):
            assert got[c, v] == (values < v).sum() + ((values == v).sum() + 1) / 2


def test_student(spark):
    cases = [(-2.0, 10), (0.0, 5), (1e-9, 3), (0.5, 1), (12.0, 1), (3.3, 37), (40.0, 4), (1.0, 100_000), (60.0, 1000), (2.0, 2)]
    got = [r[0] for r in spark.createDataFrame(cases, "t double, f long").select(stats.student_p(F.col("t"), F.col("f"))).collect()]
    for (t, f), p in zip(cases, got, strict=True):
        u = (np.arange(400_000) + 0.5) / 400_000 * math.atan(abs(t) / math.sqrt(f))  # the density over the angle
        area = math.exp(math.lgamma((f + 1) / 2) - math.lgamma(f / 2)) / math.sqrt(math.pi) * (np.cos(u) ** (f - 1)).mean() * math.atan(abs(t) / math.sqrt(f))
        assert p == pytest.approx(1 - 2 * area, abs=1e-8), (t, f)
    assert got[0] == pytest.approx(0.0733880347707403, abs=1e-14)


def brute_depths(terms):
    live = {i: set(p) for i, p, space, gone in terms if space == ontology.PROCESS and not gone}
    up = {i: p & live.keys() for i, p in live.items()}
    depth, at = {i: 0 for i, p in up.items() if not p}, 0
    while True:
        more = {i for i, p in up.items() if i not in depth and any(depth.get(q) == at for q in p)}
        if not more:
            return depth
        at += 1
        depth |= dict.fromkeys(more, at)


def test_depths_of_several_ontologies_in_one_traversal(spark):
    rng = random.Random(4)
    kind = "id string, parents array<string>, namespace string, obsolete boolean"
    chain = [(f"c{i}", [f"c{i - 1}"] if i else [], ontology.PROCESS, False) for i in range(201)]
    chain += [("shortcut", ["c200", "c5"], ontology.PROCESS, False), ("x", ["y"], ontology.PROCESS, False), ("y", ["x"], ontology.PROCESS, False)]
    bush = [(f"c{i}", [f"c{rng.randrange(i)}" for _ in range(i and 1 + i % 3)], ontology.PROCESS if i % 11 else "other", i % 13 == 12) for i in range(300)]
    got = ontology.all_depths({"chain": spark.createDataFrame(chain, kind), "bush": spark.createDataFrame(bush, kind), "none": spark.createDataFrame([], kind)})
    got, deepest = got
    assert deepest["chain"] == 200 and "none" not in deepest
    want = {("chain", i): d for i, d in brute_depths(chain).items()} | {("bush", i): d for i, d in brute_depths(bush).items()}
    assert {(r["snapshot"], r["go_id"]): r["depth"] for r in got.collect()} == want
    assert want["chain", "c200"] == 200 and want["chain", "shortcut"] == 6 and ("chain", "x") not in want


def test_levels_do_not_shuffle_the_edges(spark):
    from termdrift.scratch import Scratch

    with Scratch(spark, "bucket-test") as scratch:
        links = scratch.bucketed(spark.range(1000).selectExpr("'s' AS snapshot", "id % 50 AS parent", "id AS child"), "snapshot", "parent")
        at = scratch.write(spark.range(9).selectExpr("'s' AS snapshot", "id AS parent")).distinct()
        plan = links.hint("merge").join(at, ["snapshot", "parent"], "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and links.count() == 1000
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("termdrift")]
