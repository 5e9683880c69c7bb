"""Each operator against a brute-force version or a round trip, with nulls, empty and repeated rows, extra columns."""

import base64
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from termdrift.llm import byte_bpe, exact_dedup, labelled, line_dedup, near_dedup, packing, pii, pivot_search, quality, queries, toxicity, unigram

KIND = "doc_id long, text string, lang string, n_lines int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two")]
    base = text(rng, 120)
    rows += [(10 + i, base) for i in range(8)]
    for i in range(30):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, "\n".join(text(rng, 6) if j % 3 else "A shared line of Text  " for j in range(9))) for i in range(25)]
    rows += [(300, "word " * 20000), (301, "y" * 50000), (302, "é́ 中文 \U0001f600\x1c\x85 xİ")]
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], KIND).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_bpe_is_that_of_the_library(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN), "token_ids", "decoded")
    for i, t in texts(docs).items():
        assert list(got[i][0]) == want.encode_ordinary(t) and bytes(got[i][1]) == t.encode()
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_lines(docs, empty):
    for least in (2, 3):
        held = defaultdict(set)
        key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(near_dedup.FOLD)
        for i, t in texts(docs).items():
            for line in t.split("\n"):
                if len(key(line)) >= 10:
                    held[key(line)].add(i)
        gone = lambda i, line: len(held[key(line)]) >= least and min(held[key(line)]) != i  # noqa: B023, E731
        got = by_id(line_dedup.drop_repeated_lines(docs, min_documents=least), "n_lines", "n_dropped", "kept_text")
        for i, t in texts(docs).items():
            kept = [line for line in t.split("\n") if not gone(i, line)]
            n = t.count("\n") + 1
            assert got[i] == (n, n - len(kept), "\n".join(kept))
    assert line_dedup.drop_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_copies_even_if_digests_collide(docs, empty, digest):
    groups = defaultdict(list)
    for i, t in texts(docs).items():
        groups[t].append(i)
    got = by_id(exact_dedup.mark_copies(docs, digest, batches=3), "keep_id", "group_size", "kept")
    for ids in groups.values():
        for i in ids:
            assert got[i] == (max(ids), len(ids), i == max(ids))
    assert exact_dedup.mark_copies(empty).count() == 0


def test_near_copies(docs, empty):
    sets = {}
    for i, t in texts(docs).items():
        w = near_dedup.WORDS(t.translate(near_dedup.FOLD))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()
    of = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            if of[a] != of[b]:
                of[a] = of[b] = min(of[a], of[b])
                changed = True
    got = by_id(near_dedup.cluster_documents(docs, shingle=4), "n_shingles", "component_id", "kept")
    assert got == {i: (len(sets[i]), of[i], of[i] == i) for i in sets}
    assert near_dedup.cluster_documents(empty).count() == 0


def test_pivots_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.0] * 8), (7, [1.0] * 8), (320, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in whole:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(x) == len(y))[:20]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    got = {tuple(r) for r in pivot_search.top_inner_products(df, F.col("vec_id") % 20 == 0, candidate_block=64, query_block=4, pivots=5).collect()}
    assert got == want
    assert pivot_search.top_inner_products(df.where("false"), F.lit(True)).count() == 0


def test_personal_data(spark, docs, empty):
    t = ["mail a.b@c.d_x@e.f and 1.2.3.4.5 or 256.1.1.1", "+1 (318) 555-2368, 4437 3750 1355 7450 4437375013557451", "(318) 555-2368", None, "", "9" * 30000, "a" * 30000 + "@b.c", "é😀 x@y.zz +49 30 1234567 é"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    learn = spark.createDataFrame([(100 + i, f"call +1 ({300 + i}) 555-2{i:03d} now or ({300 + i}) 555-2{i:03d}") for i in range(200)] + [(500 + i, f"no 123-456-789-{i:03d}-3 x") for i in range(60)], "doc_id long, text string")
    found = pii.find(df.union(learn))
    got = by_id(found.select("doc_id", pii.shown("base_spans").alias("b"), pii.shown("spans").alias("s"), pii.redact(F.col("text"), F.col("spans")).alias("r")), "b", "s", "r")
    for i, s in enumerate(t):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, s or "") if ok(k, m[0])]
        assert got[i][0] == ",".join(want)
        assert set(want) <= set(got[i][1].split(",")) | {""}
    assert got[2][1] == "phone:0:14" and got[2][2] == "[PHONE]" and not any("phone" in got[500 + i][1] for i in range(60))
    assert got[7][2] == "é😀 [EMAIL] [PHONE] é"
    assert pii.find(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=512, block=16).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts(docs).items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 512)))
        for r in own:
            part = ids[512 * r["piece"] : 512 * (r["piece"] + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (512 * r["piece"], len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(empty, path).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 4, 3, 3]
    start = [[0, 5], [1, 3], [2, 4], [6]]  # 9, 9, 9, 3 of 10: one bin too many
    got = packing.improve([list(b) for b in start], lengths, 10)
    assert sorted(i for b in got for i in b) == list(range(7)) and len(got) == 3
    assert all(sum(lengths[i] for i in b) <= 10 for b in got)


def test_op5_against_brute_force(spark, docs, empty, tmp_path):
    """The query, with its fitted scores, against the best segmentation by scores that plain expectation-maximisation gives."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sorted(unigram.read_pieces(spark, path).value)
    short = docs.where("coalesce(length(text), 0) < 3000")
    short.write.parquet(f"{tmp_path}/documents.parquet")
    all_texts = texts(short)
    tokens = Counter(w for t in all_texts.values() for w in unigram.pre_tokens(t))

    longest = max(map(len, pieces))

    def ways(word, scores, floor):
        """place -> (start, piece or None, score) of every step that ends there."""
        steps = {end: [(k, word[k:end], scores[word[k:end]]) for k in range(max(0, end - longest), end) if word[k:end] in scores] for end in range(1, len(word) + 1)}
        return {end: some if any(k == end - 1 for k, _, _ in some) else [*some, (end - 1, None, floor)] for end, some in steps.items()}

    scores = dict.fromkeys(pieces, -math.log(len(pieces)))
    for _ in range(4):
        floor, expected = min(scores.values()) - unigram.UNKNOWN, dict.fromkeys(pieces, 0.5)
        for word, times in tokens.items():
            text = word.replace(" ", unigram.MARK)
            steps, forward, back = ways(text, scores, floor), {0: 0.0}, Counter({len(text): 1.0})
            for end, some in steps.items():
                forward[end] = np.logaddexp.reduce([forward[k] + s for k, _, s in some])
            for end in reversed(steps):
                for k, piece, s in steps[end]:
                    share = back[end] * math.exp(forward[k] + s - forward[end])
                    back[k] += share
                    if piece is not None:
                        expected[piece] += share * times
        total = math.log(sum(expected.values()))
        scores = {p: math.log(n) - total for p, n in expected.items()}

    def count(word):
        text, best, floor = word.replace(" ", unigram.MARK), {0: (0.0, 0)}, min(scores.values()) - unigram.UNKNOWN
        for end, some in ways(text, scores, floor).items():
            best[end] = max((best[k][0] + s, best[k][1] - (1 if p is not None else len(text[k:end].encode()))) for k, p, s in some)
        return -best[len(text)][1]

    want = {w: count(w) for w in tokens}
    got = by_id(queries.op5_token_counts(spark, str(tmp_path)), "n_tokens")
    assert got == {i: (sum(want[w] for w in unigram.pre_tokens(t)),) for i, t in all_texts.items()}
    assert queries.op5_token_counts.__name__ in queries.QUERIES and unigram.count_corpus(empty, path).count() == 0


def test_models_on_what_they_must_not_see(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good, toxic = i % 3 > 0, i % 5 == 0
        t = text(rng, 40) + (" rude nasty" * (1 + i % 4) if toxic else "")
        rows.append((i, t if good else " ".join(w + "%%%" for w in t.split())))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)}
    assert {i for i, in labelled.sample_labels(marks, "quality", 1000).select("doc_id").collect()} == {i for i in out if not out[i]}
    score = by_id(quality.score_documents(docs, marks), "score")
    severity = by_id(toxicity.grade_documents(docs, marks), "severity", "toxic")
    assert np.mean([(score[i][0] >= 0.7) == bool(q) for i, q, _ in labels if out[i]]) > 0.95
    assert np.mean([severity[i][1] == bool(x) for i, _, x in labels if out[i]]) > 0.95
    assert 0 <= score[900][0] <= 1 and severity[900] == severity[901] and not severity[900][1]
    assert quality.score_documents(docs.where("false"), marks).count() == 0
    assert by_id(quality.score_documents(docs, marks.where("false")), "score")[0] == (0.5,)
    assert by_id(toxicity.grade_documents(docs, marks.where("false")), "severity")[0] == (0.0,)

