"""Files in and out: tables as text, ontologies, sparse matrices, id lists, heterogeneous graphs, and cached results."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termdrift.functions.scalars import na_to_null, strip
from termdrift.scratch import remove
from termdrift.sources import streams


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", na_values: bool = True) -> DataFrame:
    """A text table with a header, by the names in schema; other columns are ignored. A malformed value is an error.

    na_values: texts like NA or nan count as missing, as in the analysis. A path that cannot be read is a RuntimeError."""
    try:
        raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=sep == ",", mode="FAILFAST")
    except AnalysisException as e:
        raise RuntimeError(f"{path} cannot be read") from e
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    if missing := set(names) - set(raw.columns):
        raise RuntimeError(f"{path} lacks the columns {sorted(missing)}")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return raw.select(*[(na_to_null(F.col(n)) if na_values else F.col(n)).cast(kinds[n]).alias(n) for n in names])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line long, first boolean, value: the lines of text files that are not empty, numbered from 0 in the order of the
    files' names and their places in them; first: whether a line is the first of its file.

    Files are read in splits. A split's lines are in order, so their number within it is told in the task that reads it;
    the numbers of lines of the splits before, a row for each split, make up the rest."""
    lines = spark.read.text(path).where("value <> ''").select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    lines = lines.toDF("value", "file", "block", "at")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file", "block")  # of splits, not of lines
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    told = splits.select("file", "block", "from", before.alias("before"), opens.alias("opens"))
    inside = F.col("at") - F.col("from")
    placed = lines.join(F.broadcast(told), ["file", "block"])
    return placed.select((F.col("before") + inside).alias("line"), (F.col("opens") & (inside == 0)).alias("first"), "value")


def read_nodes(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """pos, identifier of node files with a header: the nodes are numbered in their order from 0, through all files of a
    folder. Empty lines do not count. A field that goes on in the next line is an error, since lines are read apart."""
    names = spark.read.csv(path, sep="\t", header=True).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = numbered_lines(spark, path)
    whole = F.when(F.regexp_count("value", F.lit('"')) % 2 == 0, F.col("value")).otherwise(F.raise_error(F.lit("a field of a node file goes on in the next line")).cast("string"))
    headers = lines.where("first").select((F.col("line") + 1).alias("after"))  # a row for each file
    starts = headers.agg(F.array_sort(F.collect_list("after")).alias("starts"))
    pos = F.col("line") - F.size(F.filter("starts", lambda s: s <= F.col("line")))  # without the headers before it
    rows = lines.where("NOT first").crossJoin(F.broadcast(starts)).select(pos.alias("pos"), F.from_csv(whole, schema, {"sep": "\t"}).alias("x"))
    return rows.select("pos", F.col("x.identifier").cast(kind).alias("identifier"))


def parse_ontology(documents: DataFrame, stanza_mode: str = "compat") -> DataFrame:
    """id, parents, namespace, obsolete, from (value: a whole file's text).

    compat: only [Term] starts a term, so the lines of other stanzas count to the term before, as in the analysis.
    strict: any [...] line ends a term. In both the last id and namespace of a stanza count, any is_obsolete line
    makes a term obsolete whatever it says, a parent ends at an exclamation mark, and of terms with one id the last
    stays."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace("value", r"\r\n?", "\n")), r"(?m)^[\x20\t\f\x0b]+", "")
    header = r"\n\[Term\][\x20\t\f\x0b]*(?=\n|$)" if stanza_mode == "compat" else r"\n(?=\[[^\]\n]*\][\x20\t\f\x0b]*(?:\n|$))"
    parts = documents.select(F.posexplode(F.split(marked, header, -1)).alias("at", "body")).where("at > 0")
    if stanza_mode != "compat":
        parts = parts.where(F.regexp_like("body", F.lit(r"^\[Term\][\x20\t\f\x0b]*(?:\n|$)")))
    field = lambda name: F.regexp_extract_all("body", F.lit(rf"(?m)^{name}:(.*)$"), F.lit(1))
    last = lambda name: strip(F.split_part(F.try_element_at(field(name), F.lit(-1)), F.lit(f"{name}:"), F.lit(1)))
    terms = parts.select(
        "at", last("id").alias("id"), F.transform(field("is_a"), lambda p: strip(F.split_part(F.split_part(p, F.lit("is_a:"), F.lit(1)), F.lit("!"), F.lit(1)))).alias("parents"),
        last("namespace").alias("namespace"), F.regexp_like("body", F.lit(r"(?m)^is_obsolete:")).alias("obsolete"),
    ).where("id IS NOT NULL AND id <> ''")
    newest = Window.partitionBy("id").orderBy(F.desc("at"))
    return terms.withColumn("r", F.row_number().over(newest)).where("r = 1").select("id", "parents", "namespace", "obsolete")


def read_ontology(spark: SparkSession, path: str, stanza_mode: str = "compat") -> DataFrame:
    return parse_ontology(spark.read.text(path, wholetext=True), stanza_mode)


def read_matrix(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """row, col, value of the stored cells of a sparse matrix in an NPZ archive, or of several by a pattern; parts: in how
    many tasks an archive is read. It is read as a stream."""
    streams.register(spark)
    return spark.read.format("sparse_npz").option("parts", parts).load(path)


def read_square(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """a, b, jaccard of a labelled square table of similarities: a row's label and a column's, and their cell. Missing cells
    have no row. A row is turned into pairs in the task that reads it."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', mode="FAILFAST")
    label, *names = raw.columns
    cells = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[na_to_null(F.col(f"`{n}`")).cast("double") for n in names])))
    return raw.select(F.col(f"`{label}`").alias("a"), cells.alias("b", "jaccard")).where("jaccard IS NOT NULL")


def read_graph(spark: SparkSession, path: str, step: int = streams.STEP) -> tuple[DataFrame, DataFrame]:
    """nodes (kind, identifier, name), edges (kind, source, target, direction) of graph documents, compressed or not, each
    read as a stream, `step` characters at a time."""
    streams.register(spark)
    of = lambda part: spark.read.format("graph_json").options(part=part, step=step).load(path)
    return of("nodes"), of("edges")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes by kind and edges by metaedge, each a folder of Parquet."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/nodes")
    edges.withColumnRenamed("kind", "metaedge").write.mode("overwrite").partitionBy("metaedge").parquet(f"{folder}/edges")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header. A folder of files; single: of one file, for hand-over of small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_ids(ids: DataFrame, path: str, single: bool = False) -> None:
    """One id a line, sorted, in files in the order of their names; single: in one file, for hand-over of short lists."""
    lines = ids.select(F.col(ids.columns[0]).cast("string").alias("value")).distinct().orderBy("value")
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str, name: str = "go_id") -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias(name)).distinct()


def fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """Changes whenever a file of the inputs is written anew: from the path, length, time of change and checksum, where the
    file system keeps one, of every file in them. An input that is no path, like a version, counts by its text."""
    marks = []
    for name in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            marks.append((name,))
            continue
        found = system.listFiles(path, True)
        while found.hasNext():
            status = found.next()
            checksum = system.getFileChecksum(status.getPath())
            marks.append((name, status.getPath().toString(), status.getLen(), status.getModificationTime(), str(checksum)))
    return hashlib.sha256(repr(sorted(marks)).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, name: str, inputs: list[str], make) -> DataFrame:
    """The table that make() returns, kept as Parquet under a fingerprint of its inputs, and made anew if they change. It is
    written under another name and then renamed, so what is half written is never read."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(spark, inputs)}"
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place(path)):
        making = f"{path}-{uuid.uuid4().hex}"
        make().write.parquet(making)
        if not system.rename(place(making), place(path)) or system.exists(place(f"{path}/{making.rpartition('/')[2]}")):
            remove(spark, making)  # another job was first
            remove(spark, f"{path}/{making.rpartition('/')[2]}")
    return spark.read.parquet(path)
