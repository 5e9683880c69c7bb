"""What an operator must do beyond its plain cases: one test for each finding of a review."""

import math

import numpy as np

import corpus_pipeline
from termdrift.llm import near_dedup, unigram
from termdrift.llm import queries as corpus


def segmentations(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)


def test_expected_pieces_over_all_segmentations():
    pieces = ["a", "ab", "b", "ba", unigram.MARK, unigram.MARK + "a"]
    scores = dict(zip(pieces, (-1.0, -1.5, -2.0, -0.7, -3.0, -2.2), strict=True))
    words, times, want = [" abab", "xba", "b", " ", "\n\n"], [3, 1, 2, 5, 1], dict.fromkeys(pieces, 0.0)
    for word, n in zip(words, times, strict=True):
        ways = [(w, math.exp(sum(scores.get(x, -13.0) for x in w))) for w in segmentations(word.replace(" ", unigram.MARK), scores)]
        for w, p in ways:
            for x in w:
                if x in want:
                    want[x] += n * p / sum(q for _, q in ways)
    got = unigram.Expected(pieces).add(words, np.array(times, "f8"), np.array([*scores.values(), -13.0]))
    assert np.allclose(got / unigram.Expected.UNIT, list(want.values()), atol=1e-4)


def test_counts_are_of_a_unigram_model_and_keep_white_space(spark, tmp_path):
    line = "the government has information on development and it is in the form of a report"
    texts = [*[line] * 20, "government", "information", "development", "the  government\n\nhas", "\t", " ", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus.op5_token_counts(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(20, 23)] == [1, 1, 1]
    assert got[0] == len(line.split())
    assert got[23] == 6  # the, a blank, government, two newlines, has
    assert (got[24], got[25], got[26], got[27]) == (2, 1, 0, 0)  # the mark in front and a tab; one run of two blanks
    for t in texts:
        assert "".join(unigram.pre_tokens(t)) == (" " + t if t else "")


def test_near_copies_whose_signatures_agree_in_few_places(spark):
    rows = []
    for k, (seed, i) in enumerate([(11, 8830), (1, 25815), (1, 58150), (10, 59972), (5, 7301)]):
        words = [f"{seed}q{i}r{j}" for j in range(13)]
        both = " ".join(words[:11]), " ".join(words)  # 8 of 10 shingles
        by = near_dedup.coefficients(48)
        a, b = (near_dedup.signature(near_dedup.shingle_set(t.encode(), 4), by) for t in both)
        assert 22 <= (a == b).sum() < 26
        rows += [(2 * k, both[0]), (2 * k + 1, both[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.cluster_documents(df, shingle=4).collect()}
    assert got == {i: (i - i % 2, i % 2 == 0) for i, _ in rows}


def test_pipeline_keeps_one_row_of_a_text_in_a_table_twice(spark):
    rows = [(1, "same"), (2, "same"), (2, "same"), (3, "own"), (4, None), (5, ""), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(2, "same"), (3, "own"), (5, ""), (-1, "no id")])
    for table in (docs, docs.union(docs), docs.union(docs.replace("s", "t", "source"))):
        got = corpus_pipeline.without_copies(spark, table, "").collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in got) == want
        assert {r["source"] for r in got} == {"s"}
