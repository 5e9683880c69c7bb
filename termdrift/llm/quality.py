"""Quality by the votes of nearest labelled neighbours (operator 1).

A text's features are its lower-cased words, its runs of punctuation, and how much of it is in capitals or repeats the
word before. A bounded sample of labelled documents (max_labelled, by a hash of the id) gives a vocabulary: the
max_features features that most of its documents have, among those that at least least_documents have. With weights
by document frequency a truncated singular value decomposition gives `dimensions` latent dimensions. The sample's
vectors are broadcast. Every document of the corpus is projected, compared with all of them by cosine, block by block,
and its score is the mean label of its `nearest` neighbours, weighted by similarity.

Spark counts the sample's features and codes them as numbers; the driver holds these numbers alone and multiplies in
blocks of rows, so what it needs hangs on the documented bounds and not on the corpus.

Null and empty texts, and texts that share no feature with the sample, have no neighbours and get the sample's mean
label. Neighbours as near as the last that counts all vote, so ties do not hang on an order. Rows are independent:
repeated rows need no care, and an empty table stays empty. Extra columns stay; one named score is replaced. Without
any usable label every score is 0.5. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.llm.labelled import sample_texts
from termdrift.scratch import written

TOKENS = re.compile(r"\w+|[^\w\s]+").findall
CAPITALS, REPEATS = "<capitals>", "<repeats>"


def features(text: str) -> dict[str, float]:
    """Feature -> weight by frequency. The two shares count like words that occur that often in a hundred."""
    tokens = TOKENS(text)
    counts = Counter(tokens)
    out: dict[str, float] = {}
    upper = 0
    for token, n in counts.items():
        if token.isupper() and len(token) > 1:
            upper += n
        word = token.lower()
        out[word] = out.get(word, 0) + n
    out = dict(zip(out, (1 + np.log(np.fromiter(out.values(), float, len(out)))).tolist(), strict=True))
    if tokens:
        out[CAPITALS] = 20 * upper / len(tokens)
        out[REPEATS] = 20 * sum(map(eq, tokens[1:], tokens)) / len(tokens)
    return out


@dataclass
class Neighbours:
    """A fitted space with the labelled vectors in it. Its size hangs on the sample's bound alone."""

    vocabulary: dict[str, int]
    weights: np.ndarray  # by feature
    axes: np.ndarray  # feature x dimension
    vectors: np.ndarray  # labelled document x dimension, unit length
    labels: np.ndarray
    mean: float

    def project(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), "f4")
        index = self.vocabulary.get
        for i, text in enumerate(texts):
            at, values = [], []
            for feature, x in features(text).items():
                if (k := index(feature)) is not None:
                    at.append(k)
                    values.append(x)
            if at:
                out[i] = (np.array(values, "f4") * self.weights[at]) @ self.axes[at]
        return _unit(out)

    def score(self, texts: list[str], nearest: int, power: float, block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        vectors, nearest = self.project(texts), min(nearest, len(self.labels))
        for k in range(0, len(texts), block):
            cosine = vectors[k : k + block] @ self.vectors.T
            last = np.partition(cosine, len(self.labels) - nearest, axis=1)[:, len(self.labels) - nearest]
            of, at = np.nonzero(cosine >= np.maximum(last - 1e-6, 1e-6)[:, None])  # sums taken in another order tie all the same
            vote = cosine[of, at].astype(float) ** power
            weight = np.bincount(of, vote, len(cosine))
            mean = np.bincount(of, vote * self.labels[at], len(cosine)) / np.maximum(weight, 1e-12)
            out[k : k + block] = np.where(weight > 1e-9, mean, self.mean)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def coded_sample(sample: DataFrame, max_features: int, least_documents: int) -> tuple[list, pa.Table]:
    """The vocabulary as (feature, documents that have it), and of each document its quality and (feature, weight)."""

    @F.arrow_udf("array<struct<f:string,x:float>>")
    def counted(texts):
        kind = pa.list_(pa.struct([("f", pa.string()), ("x", pa.float32())]))
        return pa.array([[{"f": f, "x": x} for f, x in features(t or "").items()] for t in texts.to_pylist()], kind)

    had = written(sample.select("doc_id", "quality", counted("text").alias("c")), "quality-sample")
    each = had.select("doc_id", "quality", F.explode_outer("c").alias("c")).select("doc_id", "quality", "c.f", "c.x")
    found = each.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_documents) | F.col("f").isin(CAPITALS, REPEATS))
    common = [tuple(r) for r in found.orderBy(F.desc("n"), "f").limit(max_features).collect()]
    place = F.broadcast(had.sparkSession.createDataFrame([(f, k) for k, (f, _) in enumerate(common)], "f string, k int"))
    coded = each.join(place, "f", "left").groupBy("doc_id", "quality").agg(F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x")))).alias("c"))
    return common, coded.toArrow().sort_by("doc_id")


class Rows:
    """Sparse rows that are multiplied a block at a time."""

    def __init__(self, counts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.ends, self.columns, self.values, self.width = np.concatenate(([0], np.cumsum(counts))), columns, values, width
        of = np.repeat(np.arange(len(counts)), counts)
        length = np.sqrt(np.bincount(of, values.astype(float) ** 2, len(counts)))
        self.values = (values / np.maximum(length, 1e-12)[of]).astype("f4")

    def blocks(self, rows: int = 128):
        """(slice, dense block) of all rows in turn."""
        for k in range(0, len(self.ends) - 1, rows):
            ends = self.ends[k : k + rows + 1]
            dense = np.zeros((len(ends) - 1, self.width), "f4")
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            dense[of, self.columns[ends[0] : ends[-1]]] = self.values[ends[0] : ends[-1]]
            yield slice(k, k + len(dense)), dense

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ends) - 1, x.shape[1]), "f4")
        for own, dense in self.blocks():
            out[own] = dense @ x
        return out

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, x.shape[1]), "f4")
        for own, dense in self.blocks():
            out += dense.T @ x[own]
        return out


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 4000, dimensions: int = 48, max_features: int = 8192, least_documents: int = 3) -> Neighbours:
    """Fits on at most max_labelled documents."""
    common, rows = coded_sample(sample_texts(documents, labels, "quality", max_labelled), max_features, least_documents)
    y = rows["quality"].to_numpy().astype(float)
    if not common:
        return Neighbours({}, np.zeros(0, "f4"), np.zeros((0, 1), "f4"), np.zeros((0, 1), "f4"), np.zeros(0), float(y.mean()) if len(y) else 0.5)
    weights = np.array([1 + np.log(max(len(y) / n, 1)) for _, n in common], "f4")
    lists = rows["c"].combine_chunks()
    flat = lists.flatten()
    column = flat.field("k").to_numpy(zero_copy_only=False)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    sparse = Rows(counts, column, flat.field("x").to_numpy(zero_copy_only=False) * weights[column], len(common))
    # randomised subspace iteration for the leading right singular vectors
    axes = np.random.default_rng(0).standard_normal((len(common), min(dimensions + 8, len(common)))).astype("f4")
    for _ in range(4):
        axes = np.linalg.qr(sparse.transposed_times(sparse.times(axes)))[0]
    _, _, turn = np.linalg.svd(sparse.times(axes), full_matrices=False)
    axes = (axes @ turn.T)[:, :dimensions].astype("f4")
    return Neighbours({f: k for k, (f, _) in enumerate(common)}, weights, axes, _unit(sparse.times(axes)), y, float(y.mean()))


def score_documents(documents: DataFrame, labels: DataFrame, nearest: int = 15, power: float = 4.0, **fitting) -> DataFrame:
    """documents with score double in 0 to 1: how likely label 1 is."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, **fitting))

    @F.arrow_udf("double")
    def score(texts):
        return pa.array(model.value.score([t or "" for t in texts.to_pylist()], nearest, power))

    return documents.withColumn("score", score("text"))
