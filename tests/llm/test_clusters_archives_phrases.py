"""Centroid clustering, web archives and phrases against brute force, with nulls, ties, repeats and clashing columns."""

import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termdrift.llm import centroids, phrases, queries, warc
from termdrift.scratch import Scratch, shared_folder


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(9, 64)) * 0.4
    rows = [(i, (middle[i % 9] + rng.normal(size=64) * (0.02 if i % 3 else 0.3)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25] * 64) for i in range(60)]  # like vectors, of which several start centroids
    rows += [(7, rows[3][1]), (None, rows[5][1]), (2000, None), (2001, [0.0] * 63), (2002, [float("nan")] + [0.0] * 63), (2003, [None] + [0.0] * 63), (2004, [])]
    return rows


def lloyd(rows, clusters=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    at, x = [v for _, v in seeds], np.array([v for _, v in kept], object)
    for r in range(rounds + 1):
        far = np.array([[int(((v - np.array(c, object)) ** 2).sum()) for c in at] for v in x], object)
        near = far.argmin(1)
        if r < rounds:
            at = [[int(s) // int((near == j).sum()) for s in x[near == j].sum(0)] if (near == j).any() else c for j, c in enumerate(at)]
    return sorted((str(i), int(j), int(far[k, j])) for k, ((i, _), j) in enumerate(zip(kept, near, strict=True))), at


def test_op11_against_lloyd(spark, vectors, tmp_path):
    spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, CLUSTER string, distance int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got, (want, at) = queries.op11_centroids(spark, str(tmp_path)).collect(), lloyd(vectors)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    sums = Counter()
    for _, j, d in want:
        sums[j] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    for r in got:
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (sums[r["cluster"]], sum(sums.values()), marks[r["cluster"]])


def test_op11_of_few_and_of_huge_vectors(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    huge = [(i, [float((i % 7) * 10**e)] * 64) for e in (6, 9) for i in range(e * 100, e * 100 + 20)]
    for rows in ([(1, [0.5] * 64), (2, [0.5] * 64)], huge):
        found, at = centroids.cluster_vectors(of(rows))
        want, centres = lloyd(rows)
        assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == [(i, j, min(d, 2**63 - 1)) for i, j, d in want]
        assert at == centres
    held = of([(1, [1e30] * 64), (2, [-1e30] * 64)])  # beyond 64 bits
    assert sorted(r["cluster"] for r in centroids.cluster_vectors(held)[0].collect()) == [0, 1]
    assert centroids.cluster_vectors(of([]))[0].count() == 0


def test_bounds_skip_most_distances_and_lose_no_tie():
    rng = np.random.default_rng(1)
    x = (rng.integers(0, 8, (30, 4)).repeat(60, 0) * 400 + rng.integers(-9, 9, (1800, 4))).astype("i8")
    at, before, worked = x[::45].tolist(), None, []
    near, upper, lower = np.zeros(len(x), "i4"), np.full(len(x), np.inf, "f4"), np.zeros((len(x), len(at)), "f4")
    for _ in range(6):
        c = centroids.Centroids(at, before)
        _, n = centroids.assign(x, near, upper, lower, c)
        far = ((x[:, None] - c.at[None]) ** 2).sum(2)
        assert (near == far.argmin(1)).all()
        assert (upper.astype("f8") ** 2 >= far[np.arange(len(x)), near]).all() and (np.maximum(lower, 0).astype("f8") ** 2 <= far).all()
        worked.append(n)
        before, at = at, [[int(v) for v in x[near == j].sum(0) // (near == j).sum()] if (near == j).any() else a for j, a in enumerate(at)]
    assert worked[0] <= len(x) * len(at) and max(worked[2:]) < len(x) * len(at) / 4


def pages_rows():
    big, odd = "x" * 1500, "WARC/1.WARC/1.WARC/1." + "y" * 1200
    inner = big + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n tail"
    return [
        (1, "http://a/ b", big), (2, "http://a/c\r\nX: y", big), (3, None, None), (4, "", "short"), (5, "u", "short"), (None, "n", big),
        (None, "n", "q"), (None, "n", "z" * 999), (None, "n", "w" * 1000), (None, "m", "w" * 1000), (7, "m", inner), (8, "m", odd), (9, "m", odd),
        (2, "again", big), (2, "again", "other"), (10, "z", "\r\n\r\n\r\n\r\n"), (11, "é", " é中" * 400), (12, "é", " é中" * 400),
        (1, "http://a/ b", big), (13, "v", "v" * 3_000_000), (-4, "w", "v" * 3_000_000), *[(20 + i, f"u{i}", "hot " * 300) for i in range(40)],
    ]


def captured(rows, least=1000):
    last = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            last[html] = max(i, last.get(html, i))
    keep = lambda i, html: last.get(html) if html in last and last[html] != i else None
    full = [(i, (html or "").encode(), keep(i, html)) for i, _, html in rows]
    return sorted(map(str, [(i, len(b), hashlib.sha1(b).hexdigest(), "response" if k is None else "revisit", k) for i, b, k in full]))


@pytest.mark.parametrize("parts", [1, 4])
def test_op12_against_brute_force(spark, tmp_path, parts):
    rows = pages_rows()
    spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, record_type string, DIGEST int").repartition(parts).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r)) for r in got.collect()) == captured(rows)


def record(kind, name, block, *fields):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    """Plain and gzipped record by record, over many splits; chains of concurrent records, in both directions; lost ones."""
    folder = shared_folder(spark, "others")
    Path(folder).mkdir(parents=True)
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n"
    body = bytes(range(256)) * 40 + b"WARC/1.0\r\nno record"
    first = [
        record("warcinfo", "info", b"software: x\r\n"), record("response", "r1", http + body, "Content-Type: application/http; msgtype=response", "WARC-Concurrent-To: <q1>"),
        record("request", "q1", b"GET /"), record("metadata", "m1", b"a: 1\r\n", "WARC-Concurrent-To:\t<q1>"), record("metadata", "m0", b"a: 0\r\n", "WARC-Concurrent-To: <m1>"),
        record("resource", "s1", b"plain bytes \xff", "Content-Type: image/png"), record("request", "lost", b"GET /lost", "WARC-Concurrent-To: <nowhere>"), record("request", "none", b""),
    ]
    more = [record("response", f"p{i}", http + b"z" * i, "Content-Type: application/http", f"WARC-Concurrent-To: <x{i}>") for i in range(3000)]
    Path(f"{folder}/one.warc").write_bytes(b"".join(first))
    Path(f"{folder}/two.warc.gz").write_bytes(b"".join(map(gzip.compress, more[:1000])))
    Path(f"{folder}/three.warc").write_bytes(b"".join(more[1000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        with Scratch(spark, "warc-test") as scratch:
            got = warc.assemble(warc.read_records(spark, folder, scratch), scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {r["record_id"]: r for r in got if r["record_id"]}
    assert len(by) == 3002 and len(got) == 3004
    r = by["<r1>"]
    assert bytes(r["payload"]) == body and r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["payload_bytes"] == len(body)
    assert (r["n_requests"], r["n_metadata"], r["request"]["record_id"], r["metadata"]["record_id"]) == (1, 2, "<q1>", "<m0>")
    assert bytes(by["<s1>"]["payload"]) == b"plain bytes \xff" and by["<s1>"]["n_requests"] == 0
    assert all(bytes(by[f"<p{i}>"]["payload"]) == b"z" * i for i in range(3000))
    assert sorted(r["request"]["record_id"] for r in got if not r["record_id"]) == ["<lost>", "<none>"]


def documents_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)] + ["Der", "ÉTÉ", "x\x1cy", "a\x85b", "\x00", "New", "York", "City"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(n))
    rows = [(i, text(60), ["en", "fr", None, "und"][i % 4]) for i in range(120)]
    return rows + [(1, None, "en"), (2, "", None), (2, "one two " * 40, None), (3, " .,\n", "en"), (None, "new york city " * 40, "en"), (4, "a b c d e " * 300, "de"), (4, "a b c d e " * 300, "de"), (5, "y" * 90_000, "fr"), (6, "tick " * 50_000, "de")]


def collocations(rows, least, top):
    count, n, out = {}, Counter(), []
    for _, text, lang in rows:
        own, fold = count.setdefault(lang or "und", Counter()), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, c in count.items():
        phrase = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = {p[i : i + m] for p, a in phrase.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * c[p[i : i + m]]}
        best = []
        for p, a in phrase.items():
            if p not in within:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def test_op13_against_brute_force(spark, tmp_path):
    rows = documents_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, N int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_phrases(spark, str(tmp_path)).collect())
    assert got == collocations(rows, 30, 2000) and {r[0] for r in got} >= {"en", "de", "und"}
    for shard_words, top in ((100, 2000), (10**6, 5)):
        found = phrases.mine_phrases(docs, least=4, top=top, most_bits=1 << 15, shard_words=shard_words)
        assert sorted(tuple(r) for r in found.collect()) == collocations(rows, 4, top)
    assert phrases.mine_phrases(docs.where("false")).count() == 0


def test_counts_beyond_64_bits_when_multiplied(spark):
    big = 9 * 10**18
    counts = spark.createDataFrame([("en", "a b", big), ("en", "a", big), ("en", "b", big + 1), ("en", "a b c", big * 4 // 5), ("en", "c", big), ("en", "b c", big)], "lang string, phrase string, f long")
    pairs = counts.where("phrase LIKE '% %'").withColumnRenamed("f", "a")
    got = {r["phrase"]: r for r in phrases.scored(pairs, counts).collect()}
    assert got["a b"]["score"] == 2_000_000 * big // (2 * big + 1) and got["a b c"]["l"] == big
    assert {r["phrase"] for r in phrases.subsumed(pairs).collect()} == {"a b", "b c"}


def test_automaton_against_all_substrings():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sequence = np.concatenate([np.append(rng.integers(1, 4, rng.integers(0, 12)), 0) for _ in range(6)]).astype("i4")
        want = Counter(tuple(sequence[i : i + m]) for m in range(1, 5) for i in range(len(sequence) - m + 1) if (sequence[i : i + m] > 0).all())
        got, states = Counter(), 0
        for m, ends, least, n in phrases.SuffixAutomaton(sequence, 4).states(2):
            for end, short, count in zip(ends, least, n, strict=True):
                states += 1
                for size in range(short, m + 1):
                    got[tuple(sequence[end - size + 1 : end + 1])] += int(count)
        automaton = phrases.SuffixAutomaton(sequence, 4)
        assert got == Counter({tuple(sequence[e - m + 1 : e + 1]): int(c) for m, ends, n in automaton.strings(2) for e, c in zip(ends, n, strict=True)})
        assert got == Counter({p: c for p, c in want.items() if len(p) > 1}) and states <= len(got)


def test_bitmap_is_that_of_spark(spark):
    keys = [("fr", f"été{i}") for i in range(50)]
    may = phrases.bitmap_of(spark.createDataFrame(keys, "lang string, phrase string").select(F.xxhash64("lang", "phrase").alias("h")), 1 << 29)
    of = lambda words: np.array([xxhash.xxh64_intdigest(w.encode(), phrases.seed_of("fr")) for w in words], "u8")
    assert may.among(of(w for _, w in keys)).all() and all(int(h) in may for h in of(w for _, w in keys))
    assert may.among(of(f"autre{i}" for i in range(1000))).sum() < 10
    assert spark.range(1).select(F.xxhash64(F.lit("fr"), F.lit("a"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a", phrases.seed_of("fr"))
