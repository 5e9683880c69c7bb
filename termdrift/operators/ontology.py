"""Hierarchy of an ontology: depths, leaves, and the parents of leaves. Terms: id, parents, namespace, obsolete."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termdrift.scratch import Scratch

PROCESS = "biological_process"


def live_terms(terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    return terms.where((F.col("namespace") == namespace) & ~F.col("obsolete"))


def edges(terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    """child, parent: both live and of the namespace."""
    live = live_terms(terms, namespace)
    return live.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).join(live.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()


@contextmanager
def planned_ahead(spark: SparkSession) -> Iterator[None]:
    """Within, Spark plans an action before it runs and runs it as one job, and trusts the order within buckets. For chains
    of joins whose sides lie as they must already there is nothing to plan anew in between, and each stage would be a job
    of its own."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def one_level(reached: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """snapshot, go_id, depth: reached, and at `level` what else hangs on its terms of the level before."""
    below = (F.col("of") == F.col("snapshot")) & (F.col("parent") == F.col("go_id")) & (F.col("depth") == level - 1)
    held = links.withColumnRenamed("snapshot", "of").hint("merge").join(reached, below, "right")
    both = F.array(F.struct("go_id", "depth"), F.struct(F.col("child").alias("go_id"), F.lit(level).alias("depth")))
    each = held.select("snapshot", F.explode(both).alias("x")).select("snapshot", "x.*").where("go_id IS NOT NULL")
    return each.groupBy("snapshot", "go_id").agg(F.min("depth").alias("depth"))


def all_depths(snapshots: dict[str, DataFrame], namespace: str = PROCESS, levels: int = 8, most: int = 16) -> tuple[DataFrame, dict[str, int]]:
    """snapshot, go_id, depth: in each snapshot the fewest steps from a root, a term without a parent in the set; and the
    largest depth of each snapshot that has a term with one.

    One traversal for all snapshots, breadth first, some levels a job and twice as many in the next, up to `most`. The
    edges are written bucketed by snapshot and parent, in order, so no level shuffles or sorts them again: only the terms
    that the job has reached are, each with its fewest steps, and those of the last level meet the edges. Once an eighth as
    many terms as there are edges has been reached, edges to reached terms are left out of those that are written. What
    hangs on a cycle only has no depth."""
    named = [live_terms(t, namespace).select(F.lit(name).alias("snapshot"), "id", "parents") for name, t in snapshots.items()]
    live = reduce(DataFrame.union, named)
    with Scratch(live.sparkSession, "depths") as scratch:
        above = live.select("snapshot", F.col("id").alias("child"), F.explode_outer("parents").alias("parent"))
        known = above.join(live.select("snapshot", F.col("id").alias("parent"), F.lit(True).alias("known")).distinct(), ["snapshot", "parent"], "left")
        counted = Observation()
        dealt = known.repartition("snapshot", "parent").distinct().observe(counted, F.count_if("known").alias("n"))  # one shuffle for both
        every = scratch.bucketed(dealt, "snapshot", "parent", grouped=True)
        links, fresh = every.where("known").select("snapshot", "parent", "child"), 0
        roots = every.groupBy("snapshot", F.col("child").alias("go_id")).agg(F.count("known").alias("parents")).where("parents = 0")
        deepest, at_last, level = dict.fromkeys(snapshots, None), Observation(), 0
        largest = [F.max(F.when(F.col("snapshot") == name, F.col("depth"))).alias(f"_{k}") for k, name in enumerate(snapshots)]
        seen = scratch.write(roots.select("snapshot", "go_id", F.lit(0).alias("depth")).observe(at_last, F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("open"), *largest))
        frontier = seen
        while True:
            told = at_last.get
            deepest = {name: old if told[f"_{k}"] is None else told[f"_{k}"] for k, (name, old) in enumerate(deepest.items())}
            if not told["open"]:
                return scratch.keep(seen), {name: d for name, d in deepest.items() if d is not None}
            fresh += told["rows"] if level else 0  # no edge leads to a root
            if fresh * 8 >= counted.get["n"] > 0 and fresh:
                gone, counted, fresh = seen.select("snapshot", F.col("go_id").alias("child")), Observation(), 0
                rest = links.join(gone, ["snapshot", "child"], "left_anti").select("snapshot", "parent", "child")
                links = scratch.bucketed(rest.observe(counted, F.count(F.lit(1)).alias("n")), "snapshot", "parent")
            first, at = level, frontier
            for _ in range(levels):
                level += 1
                at = one_level(at, links, level)
            at_last = Observation()
            new = at.where(F.col("depth") > first).join(seen.hint("merge"), ["snapshot", "go_id"], "left_anti").observe(at_last, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("depth") == level).alias("open"), *largest)
            with planned_ahead(live.sparkSession):
                new = scratch.write(new)
            seen, frontier, levels = seen.union(new), new.where(F.col("depth") == level), min(2 * levels, most)


def depths(terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    """go_id, depth of one ontology."""
    return all_depths({"": terms}, namespace)[0].select("go_id", "depth")


def all_normalised(snapshots: dict[str, DataFrame], namespace: str = PROCESS) -> DataFrame:
    """snapshot, go_id, depth, max_depth, normalized_depth: depth as a share of the snapshot's largest, 0 if that is 0."""
    found, deepest = all_depths(snapshots, namespace)
    most = F.element_at(F.map_from_arrays(F.array(*map(F.lit, deepest)), F.array(*map(F.lit, deepest.values()))), F.col("snapshot")) if deepest else F.lit(None).cast("int")
    share = F.when(F.col("max_depth") > 0, F.col("depth") / F.nullif("max_depth", F.lit(0))).otherwise(0.0)
    return found.select("snapshot", "go_id", "depth", most.alias("max_depth")).withColumn("normalized_depth", share.cast("double"))


def normalised_depths(terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    """go_id, depth, max_depth, normalized_depth of one ontology."""
    return all_normalised({"": terms}, namespace).drop("snapshot")


def identify_leaf_terms(terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    """go_id of the live terms of the namespace that no other is under."""
    parents = edges(terms, namespace).select(F.col("parent").alias("id"))
    return live_terms(terms, namespace).select("id").distinct().join(parents, "id", "left_anti").select(F.col("id").alias("go_id"))


def identify_parent_terms(leaves: DataFrame, terms: DataFrame, namespace: str = PROCESS) -> DataFrame:
    """go_id of the live parents, of the namespace, of the given terms."""
    up = terms.join(leaves.select(F.col("go_id").alias("id")), "id", "left_semi").select(F.explode("parents").alias("id"))
    return up.join(live_terms(terms, namespace), "id", "left_semi").distinct().select(F.col("id").alias("go_id"))


def add_hierarchy_metrics(counts: DataFrame, terms_2016: DataFrame, terms_2024: DataFrame, go_id_column: str = "go_id", namespace: str = PROCESS) -> DataFrame:
    """counts with depth and normalized_depth of both snapshots, and their changes; null where a term is missing."""
    found = all_normalised({"2016": terms_2016, "2024": terms_2024}, namespace)
    of = lambda c, year: F.max(F.when(F.col("snapshot") == year, F.col(c))).alias(f"{c}_{year}")
    wide = found.groupBy(F.col("go_id").alias(go_id_column)).agg(*[of(c, year) for year in ("2016", "2024") for c in ("depth", "normalized_depth")])
    out = counts.join(wide, go_id_column, "left")
    return out.withColumns({"depth_change": F.col("depth_2024") - F.col("depth_2016"), "norm_depth_change": F.col("normalized_depth_2024") - F.col("normalized_depth_2016")})
