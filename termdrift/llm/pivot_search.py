"""Exact search for the highest inner products by a table of pivots (operator 6).

A bounded sample of rows yields the pivots, each the farthest from those before it. Every row is indexed: it carries
its length and its distances to all pivots, and goes to a block of bounded size with others whose nearest pivot is the
same. By the triangle inequality the largest difference between the distances of a query and of a candidate to one
pivot bounds their own distance from below, and with both lengths that bounds their inner product from above.

First each query is searched in one block of its own pivot. The score of its k-th best there is a threshold that the
result can only exceed. A block keeps the range of its distances to each pivot, so the same bound holds for blocks: a
pair of blocks whose bound is below the threshold of all its queries is left out before a row is shuffled. In the
pairs that are left, candidates whose bound is below the query's threshold are left out, and the others are evaluated
in the order of the bound, in growing steps, until the next bound is below the lowest score that still counts. Bounds have
a margin above all that rounding can take from the distances they are made of, so the result is exact. The best of each task are merged by a ranking that Spark cuts down before it shuffles.

How much is eliminated hangs on the data: much where vectors lie in groups, nothing where they are spread evenly over
many dimensions, as there all distances are about alike; then every query meets every candidate, in blocks.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. A query of
another width than a candidate has no score with it. A vector of no components has the score 0 with its like. Rows
that repeat a vec_id are all candidates, but none is a candidate for queries of its own id; the queries of one id are
ranked together. Ties go to the smaller vec_id. Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termdrift.scratch import Scratch

OUT = "query_id long, vec_id long, score long"


def whole(embedding: Column, scale: int = 64) -> Column:
    """Every component x as floor(scale * x)."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad)


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """At most `pivots` rows out of at most `sample`, by a hash of the id; the farthest first."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"].to_pylist()
    width = max((len(v) for v in got), default=0)
    rows = np.array([v for v in got if len(v) == width], float)
    if not rows.size:
        return np.zeros((0, width))
    chosen = [int(np.argmax(((rows - rows.mean(0)) ** 2).sum(1)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def indexed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with d array<double>: its length, then its distance to each pivot, where it has their width; and cell
    int: the nearest pivot, or -1."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<d:array<double>,cell:int>")
    def distances(lists):
        import pyarrow as pa

        p, d, cell = shared.value, [], []
        width = p.shape[1] if len(p) else -1
        for v in lists.to_pylist():
            x = np.array(v, float)
            far = np.sqrt(((p - x) ** 2).sum(1)) if len(v) == width else np.zeros(0)
            d.append([float(np.sqrt(x @ x)), *far.tolist()])
            cell.append(int(far.argmin()) if len(far) else -1)
        return pa.StructArray.from_arrays([pa.array(d, pa.list_(pa.float64())), pa.array(cell, pa.int32())], ["d", "cell"])

    return vectors.withColumn("x", distances("v")).select("*", "x.d", "x.cell").drop("x")


class Block:
    """The rows of a block of candidates, ready to be searched."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray):
        self.ids, self.v, self.d = ids, v, np.ascontiguousarray(d.T, "f4")
        self.square, self.most = d[:, 0] ** 2, float(np.abs(v).max(initial=0))
        self.narrow = v.astype("f4")  # exact while all sums stay below 2^24

    def scores(self, q: np.ndarray, some: np.ndarray | None) -> np.ndarray:
        """Exact inner products with the rows `some`, or with all."""
        top = float(np.abs(q).max(initial=0)) * self.most * max(len(q), 1)
        if top < 2.0**53:
            v = self.narrow if top < 2.0**24 else self.v
            return ((v if some is None else v[some]) @ q.astype(v.dtype)).astype(float)
        rows = self.v if some is None else self.v[some]
        return np.array([sum(int(a) * int(b) for a, b in zip(x, q, strict=True)) for x in rows], object)

    def best(self, own: int, q: np.ndarray, d: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best candidates for a query that reach `least`, best first."""
        gap = np.abs(self.d - d.astype("f4")[:, None]).max(0).astype(float)
        slack = 2.0**-21 * max(float(self.d.max(initial=0)), float(d.max(initial=0)))  # two distances and their gap are rounded to 24 bits
        squares = d[0] ** 2 + self.square
        most = (squares - np.maximum(gap - slack, 0) ** 2) / 2 + 2.0**-40 * squares + 0.5
        open_ = np.flatnonzero((most >= least) & (self.ids != own))
        ids, scores, step = np.zeros(0, "i8"), np.zeros(0), 8 * k
        while len(open_):
            if step < len(open_):
                parted = np.argpartition(-most[open_], step - 1)
                now, open_ = open_[parted[:step]], open_[parted[step:]]
            else:
                now, open_ = open_, open_[:0]
            found = self.scores(q, None)[now] if 2 * len(now) > len(self.ids) else self.scores(q, now)
            ids, scores = np.concatenate((ids, self.ids[now])), np.concatenate((scores, found))
            reach = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
            at = np.flatnonzero((scores >= reach) & (scores >= least))
            at = np.array(sorted(at, key=lambda i: (-scores[i], ids[i]))[:k], int)
            ids, scores = ids[at], scores[at]
            if len(ids) == k:
                open_ = open_[most[open_] >= scores[-1]]
            step *= 8
        return ids, scores


def _arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and distances of an Arrow table whose rows have one width."""
    grid = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
    return table["vec_id"].to_numpy(), grid("v"), grid("d")


def _search(k: int):
    """A function that gives the best of a block of candidates for each query of a block."""

    def best(asked, offered):
        import pyarrow as pa

        found: list[tuple[int, int, int]] = []
        if len(asked) and len(offered):
            block = Block(*_arrays(offered))
            for own, q, d, least in zip(*_arrays(asked), asked["least"].to_pylist(), strict=True):
                ids, scores = block.best(own, q, d, -np.inf if least is None else least, k)
                found += [(int(own), int(i), max(min(int(s), 2**63 - 1), -(2**63))) for i, s in zip(ids, scores, strict=True)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return best


def _ranges(rows: DataFrame, block: str) -> DataFrame:
    """width, block, low and high array<double>: the range of each distance in a block."""
    ends = rows.select("width", block, F.posexplode("d").alias("j", "x")).groupBy("width", block, "j").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return ends.groupBy("width", block).agg(F.array_sort(F.collect_list(F.struct("j", "low", "high"))).alias("r")).select("width", block, F.col("r.low").alias("low"), F.col("r.high").alias("high"))


def _open_pairs(asking: DataFrame, candidates: DataFrame, salt: int = 256) -> DataFrame:
    """width, q, c: the pairs of blocks whose bound reaches the least threshold of the queries."""
    least = asking.groupBy("width", "q").agg(F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    asked = _ranges(asking, "q").join(least, ["width", "q"]).withColumnsRenamed({"low": "low_q", "high": "high_q"})
    pairs = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).join(_ranges(candidates, "c").withColumn("salt", F.pmod("c", F.lit(salt))), ["width", "salt"])
    apart = F.zip_with(F.zip_with("low_q", "high", lambda a, b: a - b), F.zip_with("low", "high_q", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    top = lambda name: F.element_at(name, 1)
    squares = F.pow(top("high_q"), 2) + F.pow(top("high"), 2)
    far = F.greatest(F.array_max(apart) - (F.array_max("high_q") + F.array_max("high")) * 2.0**-40, F.lit(0.0))
    most = (squares - F.pow(far, 2)) / 2 + squares * 2.0**-40 + 0.5
    return pairs.where(most >= F.col("least")).select("width", "q", "c")


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 20, pivots: int = 24, sample: int = 2000, candidate_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; queries: which rows are queries, too."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("v"), queries.alias("asks"))
    with Scratch(vectors.sparkSession, "pivot-search") as scratch:
        points = indexed(rows, choose_pivots(rows, pivots, sample)).withColumns({"width": F.size("v"), "place": F.monotonically_increasing_id()})
        points = scratch.write(points)  # so that a row's place stays what it is
        # blocks are runs of the rows of a width, cell after cell
        sizes = points.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m"))  # a row for each width and pivot
        before = Window.partitionBy("width").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sizes = F.broadcast(sizes.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "m")}))
        own = lambda n, size: F.floor((F.col(f"{n}_before") + F.pmod(F.xxhash64("place", F.lit("block")), F.greatest(F.col(n), F.lit(1)))) / size)
        points = points.join(sizes, ["width", "cell"])
        candidates = points.select("vec_id", "v", "d", "width", own("n", candidate_block).alias("c"))
        asking = points.where("asks").select("vec_id", "v", "d", "width", own("m", query_block).alias("q"), own("n", candidate_block).alias("c"), F.lit(None).cast("double").alias("least"))

        search = lambda a, b, *keys: a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search(k), OUT)
        first = search(asking.select(*[F.col(c).alias(c) for c in asking.columns]), candidates, "width", "c").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("least"))
        asking = scratch.write(asking.drop("c", "least").join(first.withColumnRenamed("query_id", "vec_id"), "vec_id", "left"))
        pairs = scratch.write(_open_pairs(asking, candidates))
        near = search(asking.join(pairs, ["width", "q"]), candidates.join(pairs, ["width", "c"]), "width", "c", "q")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return scratch.keep(ranked.select("query_id", "rank", "vec_id", "score"))
