"""Files read in parts or as streams: numbered lines, sparse archives, graph documents; and caches of changed inputs."""

import bz2
import gzip
import json
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from termdrift.operators import overlap
from termdrift.sources import files, streams


def test_nodes_are_numbered_over_splits_and_files(spark, tmp_path):
    rng, n = random.Random(1), 3000
    ids = [str(rng.randrange(10**9)) for _ in range(n)]
    (tmp_path / "nodes").mkdir()
    for k, (first, last) in enumerate(((0, 1700), (1700, 1701), (1701, n))):
        lines = ["identifier\tname", *[f'{i}\t"a ""{i}"""' if int(i) % 5 else f"{i}\tplain" for i in ids[first:last]]]
        (tmp_path / "nodes" / f"part-{k}.tsv").write_text("\r\n".join(lines) + ("\r\n\r\n" if k == 1 else "\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert files.numbered_lines(spark, str(tmp_path / "nodes")).select(F.spark_partition_id()).distinct().count() > 2
        got = {r["pos"]: r["identifier"] for r in files.read_nodes(spark, str(tmp_path / "nodes"), "long").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(map(int, ids)))
    (tmp_path / "broken.tsv").write_text('identifier\tname\n1\t"a\nb"\n')
    with pytest.raises(Exception, match="goes on in the next line"):
        files.read_nodes(spark, str(tmp_path / "broken.tsv")).collect()


def sparse(path, kind, rows, cols, data, shape, compressed=True):
    order = np.lexsort((cols, rows)) if kind == "csr" else np.lexsort((rows, cols))
    rows, cols, data = rows[order], cols[order], data[order]
    members = {"format": np.array(kind.encode()), "shape": np.array(shape), "data": data}
    if kind == "coo":
        members |= {"row": rows.astype("i4"), "col": cols.astype("i4")}
    else:
        outer, inner, n = (rows, cols, shape[0]) if kind == "csr" else (cols, rows, shape[1])
        members |= {"indices": inner.astype("i4"), "indptr": np.append(0, np.cumsum(np.bincount(outer, minlength=n))).astype("i4")}
    (np.savez_compressed if compressed else np.savez)(path, **members)


@pytest.mark.parametrize("kind", ["csr", "csc", "coo"])
def test_sparse_archives_in_parts(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    shape = (211, 97)
    cells = np.flatnonzero(rng.random(shape[0] * shape[1]) < 0.1)
    cells = cells[(cells // shape[1] > 5) & (cells // shape[1] != 100)]  # empty rows at the start and within
    rows, cols, data = cells // shape[1], cells % shape[1], rng.integers(0, 3, len(cells)).astype("f4")
    sparse(tmp_path / "one.npz", kind, rows, cols, data, shape)
    sparse(tmp_path / "two.npz", kind, rows[:0], cols[:0], data[:0], shape, compressed=False)
    want = sorted(zip(rows.tolist(), cols.tolist(), data.tolist(), strict=True))
    streams.register(spark)
    for parts, step, path in ((1, 1 << 16, "one.npz"), (4, 7, "*.npz"), (3, 100, "")):
        got = spark.read.format("sparse_npz").options(parts=parts, step=step).load(str(tmp_path / path) if path else f"file://{tmp_path}").collect()
        assert sorted(map(tuple, got)) == want, (parts, path)
    np.savez(tmp_path / "odd.npz", format=np.array(b"dia"), data=data)
    with pytest.raises(Exception, match="dia"):
        files.read_matrix(spark, str(tmp_path / "odd.npz")).collect()


def test_an_archive_is_never_held_whole(tmp_path):
    n = 2_000_000
    sparse(tmp_path / "big.npz", "csr", np.arange(n) // 4, np.arange(n) % 50, np.ones(n), (n // 4, 50))
    reader = streams.SparseReader({"path": str(tmp_path / "big.npz"), "step": "10000"})
    tracemalloc.start()
    total = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n and peak < 4_000_000  # the arrays have 28 MB


def graph(n):
    nodes = [{"kind": "Gene" if i % 2 else "Term", "identifier": i if i % 2 else f"GO:{i}", "name": f'n "{i}" é\n', "data": {"x": [1, {"nodes": []}]}} for i in range(n)]
    edges = [{"source_id": ["Gene", i], "target_id": ["Term", f"GO:{i}"], "kind": "participates", "direction": "both", "data": {}} for i in range(0, n, 3)]
    return {"metanode_kinds": ["Gene", "Term"], "metaedge_tuples": [["Gene", "Term", "participates", "both"]], "kind_to_abbrev": {"Gene": "G", "nodes": [1]}, "nodes": nodes, "edges": edges}


@pytest.mark.parametrize("ending,pack", [("json", bytes), ("json.gz", gzip.compress), ("json.bz2", bz2.compress)])
def test_graph_documents(spark, tmp_path, ending, pack):
    document = graph(200)
    Path(tmp_path / f"g.{ending}").write_bytes(pack(json.dumps(document, ensure_ascii=ending == "json", indent=1 if ending == "json" else None).encode()))
    for step in (50, 1 << 16):
        nodes, edges = files.read_graph(spark, str(tmp_path / f"g.{ending}"), step)
        assert [tuple(r) for r in nodes.collect()] == [(x["kind"], str(x["identifier"]), x["name"]) for x in document["nodes"]]
        assert [tuple(r) for r in edges.collect()] == [(x["kind"], [str(y) for y in x["source_id"]], x["target_id"], x["direction"]) for x in document["edges"]]


def test_a_graph_document_is_never_held_whole(tmp_path):
    Path(tmp_path / "big.json.gz").write_bytes(gzip.compress(json.dumps(graph(60_000)).encode(), 1))
    reader = streams.GraphReader({"path": str(tmp_path / "big.json.gz"), "part": "edges", "step": "10000"})
    tracemalloc.start()
    total = sum(1 for part in reader.partitions() for _ in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 20_000 and peak < 2_000_000  # the document has 8 MB


def test_cache_sees_a_changed_input(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "cache")
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert [files.cached(spark, folder, "t", [source], make).count() for _ in range(2)] == [3, 3] and len(calls) == 1
    spark.range(10).write.mode("overwrite").parquet(source)
    assert files.cached(spark, folder, "t", [source], make).count() == 10 and len(calls) == 2
    assert files.cached(spark, folder, "t", [source, "v2"], make).count() == 10 and len(calls) == 3
    Path(folder, f"u-{files.fingerprint(spark, [source])}-half").mkdir()  # what a job left half written
    assert files.cached(spark, folder, "u", [source], make).count() == 10


def test_square_tables(spark, tmp_path):
    (tmp_path / "square.csv").write_text("term,GO:1,GO:2,GO.3\nGO:1,1,0.95,\nGO:2,0.9,1.0,0\nGO.3,nan,0,1\n")
    got = {tuple(r) for r in files.read_square(spark, str(tmp_path / "square.csv")).collect()}
    assert got == {("GO:1", "GO:1", 1.0), ("GO:1", "GO:2", 0.95), ("GO:2", "GO:1", 0.9), ("GO:2", "GO:2", 1.0), ("GO:2", "GO.3", 0.0), ("GO.3", "GO:2", 0.0), ("GO.3", "GO.3", 1.0)}


def test_position_filter_leaves_few_pairs_and_loses_none(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    sets = {}
    for k in range(160):
        own = set(rng.sample(base, 40)) if k % 4 else set(base[k // 8 * 10 : k // 8 * 10 + 40])
        for _ in range(k % 5):
            own.discard(rng.choice(sorted(own)))
            own.add(f"x{k}")
        sets[k] = own | {"common", "very common"}
    rows = [(k, x) for k, s in sets.items() for x in s] + [(None, "w1"), (5, None)]
    members = spark.createDataFrame(rows, "id long, item string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    for bound in (0.5, 0.8):
        got = {(r["a"], r["b"]): r["jaccard"] for r in overlap.jaccard_pairs(members, bound).collect()}
        assert got == {p: pytest.approx(j) for p, j in want.items() if j >= bound} and got
    ordered = overlap.ordered_sets(members)
    own = firsts(sets, 0.5)
    prefix = sum(bool(own[a] & own[b]) for a, b in want)
    compared = overlap.candidate_pairs(ordered, 0.5).count()
    assert sum(j >= 0.5 for j in want.values()) <= compared < prefix / 2
    every = {(r["a"], r["b"]) for r in overlap.jaccard_pairs(members).collect()}
    assert every == set(want)


def firsts(sets, bound):
    """The items of each set that the prefix join posts."""
    held = Counter(x for s in sets.values() for x in s)
    size = lambda s: len(s) - int(np.ceil(bound * len(s) - 1e-9)) + 1
    return {k: set(sorted(s, key=lambda x: (held[x], x))[: size(s)]) for k, s in sets.items()}
