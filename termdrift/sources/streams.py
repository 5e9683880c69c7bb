"""Files that Spark has no reader for, as data sources that read them as streams: sparse matrices in NPZ archives, and graph
documents in JSON. No file, member or array is held whole; a task holds some thousand cells or elements of it.

Files are opened by their URI in any file system that Arrow knows (local, HDFS, S3, Google's). Both formats are compressed
from their beginning on, so a task that reads a later part of a file unpacks what comes before it, without parsing it."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1 << 16
GRAPH = {
    "nodes": "kind string, identifier string, name string",
    "edges": "kind string, source array<string>, target array<string>, direction string",
}


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def matching(path: str) -> list[str]:
    """The files of a path, whose last part may be a pattern, or of a folder; sorted."""
    from pyarrow import fs

    system, inner = _file_system(path)
    folder, _, last = inner.rpartition("/")
    if not any(c in last for c in "*?["):
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [path]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        folder, last = inner.rstrip("/"), "[!._]*"
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(folder or "/")) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, last))
    scheme = path[: path.index("://") + 3 + path[path.index("://") + 3 :].index("/")] if "://" in path else ""
    return [f"{scheme}/{x.lstrip('/')}" if scheme else x for x in found]


def opened(path: str):
    system, inner = _file_system(path)
    return system.open_input_file(inner)


@dataclass
class Part(InputPartition):
    path: str
    part: int
    parts: int


class _Member:
    """An array of an archive, read from its beginning on."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        from numpy.lib import format as npy

        self.file = archive.open(f"{name}.npy")
        version = npy.read_magic(self.file)
        shape, _, self.dtype = npy.read_array_header_1_0(self.file) if version == (1, 0) else npy.read_array_header_2_0(self.file)
        self.size = shape[0] if shape else 1

    def read(self, n: int):
        import numpy as np

        want, got = n * self.dtype.itemsize, []
        while want and (data := self.file.read(want)):
            got.append(data)
            want -= len(data)
        return np.frombuffer(b"".join(got), self.dtype)

    def skip(self, n: int, step: int = STEP) -> None:
        for k in range(0, n, step):
            self.read(min(step, n - k))


class _Outer:
    """The row of each stored cell of a compressed sparse row matrix, or its column of a column one, by where rows end."""

    def __init__(self, ends: _Member, step: int):
        ends.skip(1)
        self.ends, self.step, self.row = ends, step, 0
        self.held = ends.read(step)

    def of(self, first: int, last: int):
        import numpy as np

        out = []
        while first < last and len(self.held):
            done = int(np.searchsorted(self.held, first, "right"))  # rows that end before this cell
            if done == len(self.held):
                self.row, self.held = self.row + done, self.ends.read(self.step)
                continue
            self.row, self.held = self.row + done, self.held[done:]
            here = int(np.searchsorted(self.held, last, "left"))
            until = np.minimum(self.held[: here + 1], last)
            out.append(np.repeat(np.arange(self.row, self.row + len(until)), np.diff(np.append(first, until))))
            first = int(until[-1])
        return np.concatenate([*out, np.zeros(0, "i8")])


class SparseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts, self.step = options["path"], int(options.get("parts", 1)), int(options.get("step", STEP))

    def partitions(self) -> list[Part]:
        return [Part(p, k, self.parts) for p in matching(self.path) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        with opened(partition.path) as file, zipfile.ZipFile(file) as archive:
            kind = np.load(io.BytesIO(archive.read("format.npy"))).item()
            kind = kind.decode() if isinstance(kind, bytes) else kind
            if kind not in ("csr", "csc", "coo"):
                raise ValueError(f"{partition.path} is a sparse matrix of the kind {kind}, which cannot be read")
            data, inner = _Member(archive, "data"), _Member(archive, "col" if kind == "coo" else "indices")
            outer = _Member(archive, "row") if kind == "coo" else _Outer(_Member(archive, "indptr"), self.step)
            first, last = (data.size * k // partition.parts for k in (partition.part, partition.part + 1))
            for member in (data, inner, *([outer] if kind == "coo" else [])):
                member.skip(first, self.step)
            for k in range(first, last, self.step):
                end = min(k + self.step, last)
                rows, cols = outer.read(end - k) if kind == "coo" else outer.of(k, end), inner.read(end - k)
                rows, cols = (cols, rows) if kind == "csc" else (rows, cols)
                arrays = rows.astype("i8"), cols.astype("i8"), data.read(end - k).astype("f8")
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["row", "col", "value"])


class SparseSource(DataSource):
    """Format sparse_npz: row, col, value of the stored cells of sparse matrices (csr, csc, coo) in NPZ archives. Options:
    path, a file, folder or pattern; parts, in how many tasks an archive is read; step, how many cells are held at once."""

    @classmethod
    def name(cls) -> str:
        return "sparse_npz"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> SparseReader:
        return SparseReader(self.options)


class _Document:
    """The members of a JSON object, read from a text stream bit by bit."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.text, self.at, self.over = stream, step, "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def _more(self) -> bool:
        new = self.stream.read(self.step)
        self.text, self.at, self.over = self.text[self.at :] + new, 0, not new
        return bool(new)

    def peek(self) -> str:
        """The next character that is no blank."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or not self._more():
                return self.text[self.at : self.at + 1]

    def take(self, expected: str) -> None:
        if self.peek() != expected:
            raise ValueError(f"the document has {self.peek()!r} where {expected!r} should be")
        self.at += 1

    def value(self):
        self.peek()
        while True:
            try:
                found, end = self.decode(self.text, self.at)
                if end < len(self.text) or self.over:  # else a number may go on
                    self.at = end
                    return found
            except ValueError:
                if self.over:
                    raise
            self._more()

    def elements(self) -> Iterator:
        self.take("[")
        while self.peek() != "]":
            yield self.value()
            if self.peek() == ",":
                self.at += 1
        self.take("]")

    def of(self, name: str) -> Iterator:
        """The elements of the list of that name, of one document after another."""
        while self.peek():
            yield from self._of(name)

    def _of(self, name: str) -> Iterator:
        self.take("{")
        while self.peek() != "}":
            key = self.value()
            self.take(":")
            if self.peek() == "[":
                for x in self.elements():
                    if key == name:
                        yield x
            else:
                self.value()
            if self.peek() == ",":
                self.at += 1
        self.take("}")


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part, self.step = options["path"], options.get("part", "nodes"), int(options.get("step", STEP))

    def partitions(self) -> list[Part]:
        return [Part(p, 0, 1) for p in matching(self.path)]

    def read(self, partition: Part) -> Iterator:
        text = lambda x: x if x is None or isinstance(x, str) else str(x)
        end = lambda x: x if x is None else [text(y) for y in x]
        unpack = {"bz2": bz2.open, "gz": gzip.open}.get(partition.path.rpartition(".")[2], lambda f: f)
        with opened(partition.path) as file, io.TextIOWrapper(io.BufferedReader(unpack(file)), "utf-8") as stream:
            for x in _Document(stream, self.step).of(self.part):
                if self.part == "nodes":
                    yield text(x.get("kind")), text(x.get("identifier")), text(x.get("name"))
                else:
                    yield text(x.get("kind")), end(x.get("source_id")), end(x.get("target_id")), text(x.get("direction"))


class GraphSource(DataSource):
    """Format graph_json: the nodes or edges of graph documents, of which a file may have several, plain or compressed by
    gzip or bzip2. Options: path, a file, folder or pattern; part, nodes or edges; step, how many characters are read at once."""

    @classmethod
    def name(cls) -> str:
        return "graph_json"

    def schema(self) -> str:
        return GRAPH[self.options.get("part", "nodes")]

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options)


def register(spark) -> None:
    for source in (SparseSource, GraphSource):
        spark.dataSource.register(source)
