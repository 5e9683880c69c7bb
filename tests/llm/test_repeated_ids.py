"""Tables in which ids repeat with other texts, and other cases that a hash, a bound or a group size could get wrong."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORDS, brute_components
from pyspark.sql import functions as F

import corpus_pipeline
from termdrift.llm import line_dedup, near_dedup, packing, pii, pivot_search
from termdrift.scratch import Scratch

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENT).repartition(3)


def test_lines_of_an_id_with_several_texts(spark):
    rows = [
        (1, "a line that is shared\nx"), (2, "my own first line here\na line that is shared"), (2, "a line that is shared\nanother own line of two"), (2, "a line that is shared\nanother own line of two"),
        (3, "my own first line here\nanother own line of two\na line of three"), (None, "a line that is shared"), (4, "only here twice\nonly here twice"), (4, "only here twice"),
    ]
    got = sorted((r["doc_id"] or 0, r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(documents(spark, rows)).collect())
    keep = {(2, 0): "my own first line here", (2, 1): "another own line of two", (3, 0): "a line of three"}
    want = []
    for i, t in rows:
        kept = keep.get((i, 1 if i == 2 and t.startswith("a line") else 0), t)
        want.append((i or 0, t, kept, t.count("\n") + 1, t.count("\n") - kept.count("\n")))
    assert got == sorted(want)


@pytest.fixture(scope="module")
def repeated():
    """Ids that repeat: on near copies, on unlike texts, on the same text, on a text and its form in upper case."""
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    base, other, third = some(100), some(100), some(60)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(1, base), (5, near), (5, other), (6, other + " more"), (7, third), (7, third.upper()), (8, third), (9, "x y"), (9, "x z"), (9, None), (None, base), (10, base), (10, base)]
    return rows + [(100 + i % 4, some(50)) for i in range(24)]


def test_classes_of_an_id_with_several_texts(spark, repeated):
    rows = [*repeated, *[(i, None if t is None else t + " and so on") for i, t in repeated if i]]  # united with itself under other texts
    known = [(k, i, t or "") for k, (i, t) in enumerate(rows) if i is not None]
    _, of = brute_components({k: t for k, _, t in known}, 4)
    smallest = {}
    for k, i, _ in known:
        smallest[of[k]] = min(i, smallest.get(of[k], i))
    want = Counter((i, smallest[of[k]], i == smallest[of[k]]) for k, i, _ in known) + Counter((None, None, True) for i, _ in rows if i is None)
    got = near_dedup.cluster_documents(documents(spark, rows), shingle=4)
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()) == want


def test_stage_keeps_unlike_texts_of_one_id(spark, repeated):
    docs = documents(spark, repeated)
    unique = corpus_pipeline.without_copies(spark, docs, "")
    before = [(r["doc_id"], r["text"] or "") for r in unique.collect()]
    assert sorted(t for _, t in before) == sorted({t or "" for _, t in repeated})
    after = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.without_near_copies(spark, unique, "").collect()]
    known = {k: t for k, (i, t) in enumerate(before) if i is not None}
    _, of = brute_components(known, 5)
    groups = defaultdict(list)
    for k in known:
        groups[of[k] if known[k].split() else ("alone", k)].append(before[k])
    left = Counter(after)
    for members in groups.values():
        stay = [m for m in members if left[m]]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in members)
    assert len(after) == len(groups) + sum(i is None for i, _ in before)


@pytest.mark.parametrize("low,high,n", [(2049, 3890, 3000), (2100, 2100, 3000), (1, 4096, 3000), (1200, 1700, 3000)])
def test_packing_levels_end_with_no_group_above_the_bound(spark, monkeypatch, low, high, n):
    rng = random.Random(low)
    rows = [(i, 0, 0, rng.randint(low, high), i) for i in range(n)]
    inner, seen = packing.place, spark.sparkContext.accumulator(0)

    def counted(lengths, capacity):
        if len(lengths) > 400:
            seen.add(1)
        return inner(lengths, capacity)

    monkeypatch.setattr(packing, "place", counted)
    with Scratch(spark, "packing-test") as scratch:
        pieces = scratch.write(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4))
        got = packing.pack_pieces(pieces, 4096, scratch, block=300).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((r[0], r[3]) for r in rows) and not seen.value
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    tokens = -(-sum(r[3] for r in rows) // 4096)
    if low > 2048:
        assert len(sequences) == n
    elif high == 4096:
        assert len(sequences) <= tokens * 1.03
    else:
        bins, _ = inner([r[3] for r in rows], 4096)  # all in one group
        assert len(sequences) <= (max(bins) + 1) * 1.03


def test_search_with_outliers_in_many_blocks(spark):
    """Rows far beyond all others make distances whose 32-bit forms are rough; the results stay exact."""
    rng = np.random.default_rng(7)
    for far in (1e6, 1e7):
        v = np.concatenate([rng.integers(-45, 45, (400, 6)).astype(float), rng.integers(-45, 45, (4, 6)) * far / 45])
        ids = np.concatenate([np.arange(300), np.full(100, 20), np.arange(1000, 1004)])  # one id is a quarter of all rows
        df = spark.createDataFrame(list(zip(ids.tolist(), v.tolist(), strict=True)), "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in pivot_search.top_inner_products(df, F.col("vec_id") % 20 == 0, k=5, pivots=3, candidate_block=40, query_block=7).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        w = [[int(np.floor(64 * x)) for x in row] for row in v]
        for q in {int(i) for i in ids if i % 20 == 0}:
            asks = [k for k, i in enumerate(ids) if i == q]
            every = sorted((-sum(a * b for a, b in zip(w[k], w[c], strict=True)), int(ids[c])) for k in asks for c in range(len(ids)) if ids[c] != q)
            assert [(i, -s) for s, i in every[:5]] == [(i, s) for _, i, s in sorted(got[q])], (far, q)


def test_a_block_with_a_far_pivot():
    rng = np.random.default_rng(3)
    for far in (6.4e8, 6.4e9):
        pivots = np.array([[far, far]])
        v = rng.integers(-3000, 3000, (500, 2)).astype(float)
        index = lambda rows: np.hstack([np.sqrt((rows**2).sum(1))[:, None], np.sqrt(((rows[:, None] - pivots[None]) ** 2).sum(2))])  # noqa: E731, B023
        block = pivot_search.Block(np.arange(500), v, index(v))
        for q in rng.integers(-3000, 3000, (200, 2)).astype(float):
            ids, scores = block.best(-1, q, index(q[None])[0], -np.inf, 3)
            want = sorted((-float(x @ q), i) for i, x in enumerate(v))[:3]
            assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want


def test_secrets_with_long_heads(spark):
    head = "a" * 300
    rows = [(1, f"token = {head}9{head}"), (2, "x = " + "7" * 200 + "q"), (3, "z" * 50_000), (4, "1" * 50_000 + "b")]
    found = documents(spark, rows).select("doc_id", F.regexp_extract("text", pii.PROPOSED["secret"].split("|(?<=[=:]")[0], 0).alias("s"))
    assert {r["doc_id"]: len(r["s"]) for r in found.collect()} == {1: 601, 2: 201, 3: 0, 4: 50_001}
