"""The stages, one after another, against brute force over the documents that the stage before kept."""

import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from brute import KIND, brute_components, corpus_rows
from pyspark.sql import functions as F

import corpus_pipeline
from termdrift.llm import quality


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows = corpus_rows() + [(None, "no id at all"), (20, corpus_rows()[7][1]), (500, "password = " + "9f3c" * 8)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(300 + i, int(i % 3 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    scores = {(r["doc_id"], r["text"]): r["score"] for r in quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        after, key = docs.collect(), lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
        if name == "quality":
            assert sorted(map(key, after)) == sorted(key(r) for r in before if scores[r["doc_id"], r["text"]] >= 0.7)
            assert 0 < len(after) < len(before)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[r["text"] or ""].append(r["doc_id"])
            assert len(after) == len(groups) < len(before)
            for r in after:
                own = groups[r["text"] or ""]
                assert r["doc_id"] == max((i for i in own if i is not None), default=None)
        elif name == "near_dedup":
            _, of = brute_components({r["doc_id"]: r["text"] or "" for r in before if r["doc_id"] is not None}, 5)
            assert sorted(map(key, after)) == sorted(key(r) for r in before if r["doc_id"] is None or of[r["doc_id"]] == r["doc_id"])
            assert len(after) < len(before)
        elif name == "pii":
            assert sorted(map(str, (r["doc_id"] for r in after))) == sorted(map(str, (r["doc_id"] for r in before)))
            for r in after:
                assert r["n_chars"] == len(r["text"]) and not re.search(r"[\w.]+@\w+\.\w+|\+49 \(30\)|10\.0\.0\.25\b(?!6)|4111 1111 1111 1111", r["text"])
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted(-(-(len(library.encode(r["text"], add_special_tokens=False).ids) + 1) // 4096) for r in before)
            got = defaultdict(int)
            for r in after:
                got[r["doc_id"]] += 1
            assert sorted(got.values()) == want
        seen[name], before = len(after), after
        docs = spark.createDataFrame(after, docs.schema)
    assert corpus_pipeline.run(spark, sf).count() == seen["packing"]


def test_crc_of_pieces_is_that_of_what_stays(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("offset + length > 4096").isEmpty() and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()
    assert zlib.crc32(b"\x01\x00\x00\x00") not in {r["ids_crc32"] for r in out.where("length > 1").collect()}
