"""Connected components of an undirected graph, as a few rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node on an edge. Loops and repeated edges do no harm.

    Alternates two steps until nothing changes. In the large-star step every node hands its larger neighbours to the
    smallest node around it; in the small-star step its smaller ones. Both keep the components, and every round brings
    each node nearer to its smallest; the number of rounds grows with the logarithm of the longest path, so a chain is
    no worse than a bush. Minima are combined before they are shuffled, so a hub costs a row per task. The tables of
    the rounds are deleted at the end.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    with Scratch(edges.sparkSession, "components") as scratch:
        links = scratch.write(edges.where(F.col(a) != F.col(b)).select(*pair(F.col(a), F.col(b))).distinct())
        last = None
        for _ in range(max_rounds):
            both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = large.distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u")
            links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
            links = scratch.write(links)
            now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == last or not now[0]:
                break
            last = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        ends = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return scratch.keep(links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends))
