"""Toxicity as an ordinal severity (operator 4).

A cumulative-link model with the logistic link: P(grade <= k) = logistic(t_k - w.x), one weight per word for all
thresholds t_1 < t_2 < t_3, on sparse features log(1 + count) of the hashed words of a text. Grades are 0, clean, and
1 to 3. The labels only tell clean from toxic, so the grades of toxic training documents are set from the density of
words that the labels show to be tied to toxicity: at most once in two hundred words, at most once in fifty, or more.
It learns from a bounded sample of labelled rows (max_labelled, by a hash of the id). A document's severity is the
expected grade; grade is the likeliest, and a document is toxic if grades above 0 are likelier than not.

Null and empty texts have no words and get the severity of a text without any; a very long text counts whole. Rows are
independent: repeated rows need no care, and an empty table stays empty. Of two grades equally likely the lower one is
given. Extra columns stay; those named severity, grade or toxic are replaced. Without usable labels of both classes
every severity is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termdrift.llm.labelled import sample_texts
from termdrift.llm.recent import Recent
from termdrift.llm.tables import fresh, without

WORDS = re.compile(r"\w+").findall
BUCKETS = 1 << 18
#: Densities of tied words that part the grades 1, 2 and 3.
GRADE_CUTS = (0.005, 0.02)


def slot(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % BUCKETS


def counts(text: str, slots: Recent) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots, their counts, and the number of words."""
    words = WORDS(text)
    by_word = Counter(words)
    at = np.fromiter(map(slots.__getitem__, by_word), "i8", len(by_word))
    n = np.fromiter(by_word.values(), "f8", len(by_word))
    own, back = np.unique(at, return_inverse=True)
    return own, np.bincount(back, n, len(own)), len(words)


@dataclass
class Severity:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, text: str, slots: Recent) -> np.ndarray:
        """The probability of each grade."""
        at, n, _ = counts(text, slots)
        eta = float(self.weights[at] @ np.log1p(n)) if len(at) else 0.0
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - eta, -500, 500)))
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def _tied(rows: list, toxic: np.ndarray) -> np.ndarray:
    """Slots whose words occur in toxic documents far beyond their share of all."""
    hit, miss = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (at, _, _), y in zip(rows, toxic, strict=True):
        (hit if y else miss)[at] += 1
    odds = np.log((hit + 0.5) / (toxic.sum() + 1)) - np.log((miss + 0.5) / ((~toxic).sum() + 1))
    return (odds > 2.0) & (hit >= max(5, 0.02 * toxic.sum()))


def fit_rows(rows: list, toxic: np.ndarray, steps: int = 400, penalty: float = 2e-3) -> Severity | None:
    """Maximum likelihood with a quadratic penalty, by full-batch steps of adaptive size."""
    if not toxic.any() or toxic.all():
        return None
    tied = _tied(rows, toxic)
    density = np.array([n[tied[at]].sum() / max(words, 1) for at, n, words in rows])
    grade = np.where(toxic, 1 + np.searchsorted(GRADE_CUTS, density), 0)
    of = np.repeat(np.arange(len(rows)), [len(at) for at, _, _ in rows])
    slots, column = np.unique(np.concatenate([at for at, _, _ in rows]), return_inverse=True)
    x = np.log1p(np.concatenate([n for _, n, _ in rows]))
    few = np.bincount(column, minlength=len(slots)) < 3  # too rare to learn from
    w, level, steps_up = np.zeros(len(slots)), 2.0, np.array([np.log(1.0), np.log(1.0)])
    p = np.concatenate((w, [level], steps_up))
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w = p[:-3]
        t = p[-3] + np.concatenate(([0.0], np.cumsum(np.exp(p[-2:]))))
        eta = np.bincount(of, x * w[column], len(rows))
        upper = np.where(grade < 3, logistic(np.append(t, 0)[grade] - eta), 1.0)
        lower = np.where(grade > 0, logistic(np.append(t, 0)[grade - 1] - eta), 0.0)
        own = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / own, lower * (1 - lower) / own  # derivatives of the log likelihood by the cuts
        by_cut = np.array([up[grade == k].sum() - low[grade == k + 1].sum() for k in range(3)]) / len(rows)
        by_w = np.bincount(column, x * (low - up)[of], len(slots)) / len(rows) - penalty * w
        gaps = np.exp(p[-2:])
        slope = np.concatenate((by_w, [by_cut.sum()], [by_cut[1:].sum() * gaps[0], by_cut[2] * gaps[1]]))
        slope[: len(slots)][few] = 0
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros(BUCKETS)
    weights[slots] = p[:-3]
    return Severity(weights, p[-3] + np.concatenate(([0.0], np.cumsum(np.exp(p[-2:])))))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> Severity | None:
    """Fits on at most max_labelled documents, of which only word counts by slot reach the driver."""

    @F.arrow_udf("struct<at:array<long>,n:array<double>,words:long>")
    def counted(texts):
        import pyarrow as pa

        memo = Recent(slot)
        rows = [counts(t or "", memo) for t in texts.to_pylist()]
        kind = pa.struct([("at", pa.list_(pa.int64())), ("n", pa.list_(pa.float64())), ("words", pa.int64())])
        return pa.array([{"at": a.tolist(), "n": n.tolist(), "words": k} for a, n, k in rows], kind)

    got = sample_texts(documents, labels, "toxic", max_labelled).select("doc_id", "toxic", counted("text").alias("c")).toArrow().sort_by("doc_id")
    lists = got["c"].combine_chunks()
    at, n, words = (lists.field(k) for k in ("at", "n", "words"))
    cuts = np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    each = zip(np.split(at.flatten().to_numpy(), cuts), np.split(n.flatten().to_numpy(), cuts), words.to_pylist(), strict=True) if len(lists) else ()
    return fit_rows(list(each), np.array(got["toxic"].to_pylist(), bool))


def grade_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """documents with severity double in 0 to 3, grade int and toxic boolean."""
    model = fit(documents, labels, max_labelled)
    documents = without(documents, "severity", "grade", "toxic")
    if model is None:
        return documents.withColumns({"severity": F.lit(0.0), "grade": F.lit(0), "toxic": F.lit(False)})
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity:double,grade:int,toxic:boolean>")
    def graded(texts):
        import pyarrow as pa

        p = np.array([shared.value.grades(t or "", _SLOTS) for t in texts.to_pylist()]).reshape(-1, 4)
        fields = [pa.array(p @ np.arange(4)), pa.array(p.argmax(1).astype("i4")), pa.array(p[:, 0] < 0.5)]
        return pa.StructArray.from_arrays(fields, ["severity", "grade", "toxic"])

    own = fresh(documents, "_graded")
    return documents.withColumn(own, graded("text")).select(*documents.columns, f"{own}.*")


_SLOTS = Recent(slot)
