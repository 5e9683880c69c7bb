"""Centroid clustering by Elkan's bounds, in whole numbers (operator 11).

Every vector carries, from round to round, its cluster, an upper bound of the distance to that centroid and a lower bound
for each centroid. After the centroids move, the bounds are loosened by how far; with half the distances between centroids
they tell which distances cannot matter, and only the others are worked out. Bounds are 32-bit floats, always rounded to
the safe side, and a centroid is skipped only where a bound rules it out strictly, so ties are found and go to the smaller
number. What decides, the squared distance, is an exact integer; the distances returned are worked out anew in the end.

A round is one pass over the table of vectors with their bounds, written to the shared folder, and one that sums the
components of each cluster: per task one row for each cluster and component, so a cluster with a third of all vectors is
no larger than any other. The driver holds centroids alone; the table of the round before goes once a round is done.

Vectors that are null, of another width, or hold null or non-finite components take no part. Rows without an id are
clustered but never start a centroid. Rows that repeat an id each count; like vectors may start several centroids, of
which the smallest number gets them all and the others stay where they are. With fewer vectors than `clusters` each starts
a centroid. Components are held to 64 bits, and so are distances and their sums. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.llm.pivot_search import usable, whole
from termdrift.scratch import Scratch

STATE = "vec_id long, v array<long>, cluster int, upper float, lower array<float>"
MOST = 2**63 - 1


def wide(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether a squared distance of a row of x to one of c may be beyond 64 bits."""
    top = sum(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (x, c))
    return x.shape[-1] * top * top > MOST


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to c, a row or as many: 64-bit integers where they suffice, else Python's."""
    if wide(x, c):
        x, c = x.astype(object), c.astype(object)
    return ((x - c) ** 2).sum(-1)


def above(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(distance.astype("f4"), np.float32("inf"))


def below(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(distance.astype("f4"), np.float32("-inf"))


def root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype("f8"))


class Centroids:
    """Centroids of a round, what is known of the distances between them, and how far each moved since the last."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None = None):
        self.at = np.array(at, "i8")
        self.half = np.array([below(root(squares(self.at, c)) / 2) for c in self.at])
        np.fill_diagonal(self.half, np.inf)
        self.clear = self.half.min(1)  # below this, no other centroid can be as near
        moved = squares(self.at, np.array(before, "i8")) if before else np.zeros(len(at), "i8")
        self.moved = above(root(moved)).astype("f8")


def assign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, int]:
    """Moves near, upper and lower, in place, to the centroids of c. Returns the exact squared distance to the own centroid
    where it was worked out, else -1, and how many distances were."""
    upper[:] = above(upper.astype("f8") + c.moved[near])
    lower[:] = below(lower.astype("f8") - c.moved)
    own = np.full(len(x), -1, object if wide(x, c.at) else "i8")
    worked = 0
    rows = np.flatnonzero(upper >= c.clear[near])
    may = lambda r, j: r[(near[r] != j) & (upper[r] >= lower[r, j]) & (upper[r] >= c.half[near[r], j])]
    for j in range(len(c.at)):
        open_ = may(rows, j)
        loose = open_[own[open_] < 0]
        worked += settle(loose, x, near, upper, lower, c, own)
        open_ = may(open_, j)
        if len(open_):
            found = squares(x[open_], c.at[j])
            worked += len(open_)
            lower[open_, j] = below(root(found))
            held = own[open_]
            closer = (found < held) | ((found == held) & (j < near[open_]))
            won = open_[closer]
            near[won], own[won], upper[won] = j, found[closer], above(root(found[closer]))
    return own, worked


def settle(rows: np.ndarray, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, own: np.ndarray) -> int:
    """Works out the distance of rows to their own centroids."""
    if len(rows):
        own[rows] = squares(x[rows], c.at[near[rows]])
        far = root(own[rows])
        upper[rows], lower[rows, near[rows]] = above(far), below(far)
    return len(rows)


def _grid(column, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _round(shared, width: int, last: bool):
    """A pass over the vectors that assigns them to the shared centroids; the last one gives exact distances in place of bounds."""

    def step(batches) -> Iterator:
        import pyarrow as pa

        c = shared.value
        k = len(c.at)
        for batch in batches:
            x, near = _grid(batch["v"], width, "i8"), batch["cluster"].to_numpy().copy()
            upper, lower = batch["upper"].to_numpy().copy(), _grid(batch["lower"], k, "f4")
            own, _ = assign(x, near, upper, lower, c)
            if last:
                settle(np.flatnonzero(own < 0), x, near, upper, lower, c, own)
                held = pa.array([min(int(d), MOST) for d in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(near), held], ["vec_id", "cluster", "distance"])
            else:
                ends = pa.array(np.arange(len(x) + 1, dtype="i4") * k)
                bounds = pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(near), pa.array(upper), bounds], ["vec_id", "v", "cluster", "upper", "lower"])

    return step


def _sums(width: int):
    """A function that gives, for each cluster and component of a task, the sum, and at place -1 the number of vectors."""

    def step(batches) -> Iterator:
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x, near = _grid(batch["v"], width, "i8"), batch["cluster"].to_numpy()
            fits = len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) <= MOST
            for j in np.unique(near):
                own = x[near == j]
                total = np.array([len(own), *(own if fits else own.astype(object)).sum(0)], object)
                totals[int(j)] = totals[int(j)] + total if int(j) in totals else total
        rows = [(j, i - 1, int(s)) for j, total in totals.items() for i, s in enumerate(total)]
        cluster, place, sums = zip(*rows, strict=True) if rows else ((), (), ())
        texts = pa.array(map(str, sums), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), texts], ["cluster", "place", "total"])

    return step


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids come first by a hash; of rows that repeat an id, by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in rows.where(F.col("vec_id").isNotNull()).select("v", order.alias("h")).orderBy("h", "v").limit(clusters).collect()]


def moved_centroids(state: DataFrame, at: list[list[int]], width: int) -> list[list[int]]:
    """The means of the clusters, rounded down; an empty cluster's centroid stays."""
    parts = state.select("v", "cluster").mapInArrow(_sums(width), "cluster int, place int, total string")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()
    total = {(r["cluster"], r["place"]): int(r["s"]) for r in sums}  # a number for each centroid and component
    return [[total[j, i] // total[j, -1] for i in range(width)] if (j, -1) in total else c for j, c in enumerate(at)]


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of the vectors of that width, and the centroids they were assigned to last."""
    spark = vectors.sparkSession
    fit = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == width))
    with Scratch(spark, "centroids") as scratch:
        rows = scratch.write(fit.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("v")))
        at = first_centroids(rows, clusters, seed)
        if not at:
            return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
        free = F.array_repeat(F.lit(0.0).cast("float"), len(at))
        state, before = rows.select("*", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), free.alias("lower")), None
        for _ in range(rounds):
            shared, old = spark.sparkContext.broadcast(Centroids(at, before)), scratch.last
            state = scratch.write(state.mapInArrow(_round(shared, width, False), STATE))
            scratch.drop(old)
            before, at = at, moved_centroids(state, at, width)
        shared = spark.sparkContext.broadcast(Centroids(at, before))
        return scratch.keep(state.mapInArrow(_round(shared, width, True), "vec_id long, cluster int, distance long")), at


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia and inertia, the distances summed over a cluster and over all, and centroid_sha256."""
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["cluster"]: int(r["s"]) for r in each}  # a number for each centroid
    one = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance",
        one([min(sums.get(j, 0), MOST) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), one(marks, "string").alias("centroid_sha256"),
    )
