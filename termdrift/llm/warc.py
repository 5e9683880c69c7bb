"""Web archives written and read back, with the records of a capture assembled by their identifiers (operator 12).

Writing: each page is a capture of three records, a request, a response and a metadata record, which name the response in
WARC-Concurrent-To. Of pages with equal payloads of at least `least_bytes` the one with the largest page_id is a response,
the others revisit it and hold no payload. Which pages revisit is told from ids, sizes and digests alone, combined before
they are shuffled; a bitmap of bounded size keeps all pages that surely do not out of the join that tells the others. A
record is a line of Spark's text writer whose line separator is the empty lines that end a record, so archives are plain
files, gzipped, of at most `per_archive` records, in whatever file system Spark writes.

Reading: archives are read as lines that end at the mark of a record's version, so a plain archive is read in parts and a
gzipped one as a stream, record by record, never whole. A line as long as its record's length says is that record. Where
a payload holds the mark itself, the lines of that archive are numbered, the records are told by adding up lengths from
its start, on numbers alone, and the lines of each such record are put together.

Assembly: records other than responses, revisits and resources are joined to those by WARC-Concurrent-To, whichever side
names the other, and over further records of the same capture, in as many rounds as the longest chain. Each response,
revisit or resource is one nested row, with the request and the metadata record that have the smallest identifier and with
their numbers; a record whose capture is not there is a row of its own. Revisits are then joined to what they refer to.

Null html is an empty payload; equality is that of bytes, by SHA-1. A page without id is a revisit where a page with an id
has its payload, else a response. Rows that repeat an id and a payload are all responses or all revisits, and come back
as often as they went in. Rows that repeat an id with other payloads are captures of their own. Blanks and control
characters in a url become %20; a null url is left out. Payloads are as transferred, without decoding. Extra columns are
ignored, and an empty table gives an archive without records and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termdrift.llm.bitmap import split
from termdrift.scratch import Scratch

#: Fixed values of the format.
VERSION, MARK, LINE = "WARC/1.1", "WARC/1.", "\r\n"
BLANK_LINE = LINE + LINE
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
DATE = "1970-01-01T00:00:00Z"


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, digest, keep_id: the pages, by id and payload, whose payload another page with a larger id holds."""
    payload = payload_of(F.col("html"))
    known = pages.where(F.octet_length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("digest"))
    each = known.distinct()
    kept = each.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep_id IS NOT NULL")
    return each.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("keep_id"))).select("page_id", "digest", "keep_id")


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _record(block: Column, *fields: tuple[str, Column | str]) -> Column:
    """A record up to its end mark, which the writer adds. Fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in fields]
    return F.concat(F.concat_ws(LINE, F.lit(VERSION), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(BLANK_LINE), block)


def capture_records(pages: DataFrame, keep_id: str, digest: str, date: str = DATE) -> DataFrame:
    """value: the records of pages (page_id, url, html); keep_id: the page that the page revisits, if it does."""
    payload = F.coalesce("html", F.lit(""))
    uri = F.nullif(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    own = record_id("response", F.col("page_id"), F.col(digest))
    again = F.col(keep_id).isNotNull()
    when = lambda c: F.when(again, c)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(BLANK_LINE))
    response = _record(
        F.when(again, http).otherwise(F.concat(http, payload)), ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), ("WARC-Profile", when(F.lit(SAME_PAYLOAD))),
        ("WARC-Refers-To", when(record_id("response", F.col(keep_id), F.col(digest)))), ("Content-Type", "application/http;msgtype=response"),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{BLANK_LINE}"))
    named = lambda name: ("WARC-Record-ID", record_id(name, F.col("page_id"), F.col(digest)))
    kind = lambda name: (("WARC-Type", name), named(name), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own))
    request = _record(asked, *kind("request"), ("Content-Type", "application/http;msgtype=request"))
    fields = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit("")), F.lit(f"languages-cld2: none{LINE}"))
    metadata = _record(fields, *kind("metadata"), ("Content-Type", "application/warc-fields"))
    return pages.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 1000, per_archive: int = 60_000) -> None:
    """pages (page_id, url, html) as gzipped archives in the folder path."""
    again = scratch.write(revisits(pages, least_bytes))
    rows = pages.select("page_id", "url", "html", F.sha1(payload_of(F.col("html"))).alias("digest"))
    key = F.xxhash64("page_id", "digest")
    keyed = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "keep_id", key.alias("_key"))
    maybe, surely_not = split(rows, key, keyed, "_key")
    told = maybe.join(keyed.hint("merge"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select(*maybe.columns, "keep_id")
    every = told.union(surely_not.withColumn("keep_id", F.lit(None).cast("long")))
    records = capture_records(every, "keep_id", "digest")
    records.write.option("lineSep", BLANK_LINE).option("maxRecordsPerFile", per_archive).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """raw: what stands between two marks; file, block, at: where, in order; ends and says: the place where its header
    ends and the length that it declares, in bytes, null where there is none."""
    raw = spark.read.text(path, lineSep=MARK).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    raw = raw.toDF("raw", "file", "block", "at")
    head = F.substring_index("raw", BLANK_LINE, 1)
    ends = F.octet_length(head)
    told = raw.withColumns({"head": head, "ends": F.when(ends < F.octet_length("raw"), ends.cast("long"))})
    says = F.regexp_extract("head", r"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})(?:\r|$)", 1)
    return told.withColumn("says", F.nullif(says, F.lit("")).cast("long"))


def _odd_archives(lines: DataFrame) -> DataFrame:
    """file of those in which a line is not a record. One empty line, before the first mark, is as it should be."""
    whole = F.coalesce(F.col("ends") + 4 + F.col("says") + 4 == F.octet_length("raw"), F.lit(False))
    empty = F.col("raw") == ""
    return lines.groupBy("file").agg(F.count_if(~whole & ~empty).alias("parts"), F.count_if(empty).alias("empty")).where("parts > 0 OR empty > 1").select("file")


def _numbered(pdf):
    """Lines of an archive, in order -> the record that each is a part of, by the lengths from the start on."""
    pdf = pdf.sort_values(["block", "at"])
    records, record, need, got, length = [], -1, 0, 0, None
    for k, (size, ends, says) in enumerate(zip(pdf["size"], pdf["ends"], pdf["says"], strict=True)):
        if k == 0 and size == 0:  # before the first mark
            records.append(-1)
            continue
        if got >= need and need >= 0:  # the record before is complete
            record, need, got, length = record + 1, -1, 0, None
        else:
            got += len(MARK)
        length = says if length is None and says == says else length
        if need < 0 and ends == ends:
            need = got + ends + 4 + (length or 0) + 4
        got += size
        records.append(record)
    pdf["record"] = records
    return pdf[["file", "block", "at", "record"]]


def _mended(lines: DataFrame) -> DataFrame:
    """Lines of archives in which a payload holds the mark, as one line a record."""
    sizes = lines.select("file", "block", "at", F.octet_length("raw").cast("double").alias("size"), F.col("ends").cast("double").alias("ends"), F.col("says").cast("double").alias("says"))
    part_of = sizes.groupBy("file").applyInPandas(_numbered, "file string, block long, at long, record long")  # numbers of one archive
    told = lines.select("file", "block", "at", "raw").join(part_of, ["file", "block", "at"]).where("record >= 0")
    parts = told.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "raw"))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda p: p["raw"]), MARK).alias("raw"))


def read_records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The records of archives, plain or gzipped: their fields, then block binary, and of captures payload binary,
    payload_bytes long and payload_digest, the SHA-1 of the payload in hexadecimal letters."""
    lines = _lines(spark, path)
    odd, texts = scratch.write(_odd_archives(lines)), lines.select("raw")
    if not odd.isEmpty():
        texts = lines.join(odd, "file", "left_anti").select("raw").union(_mended(lines.join(odd, "file", "left_semi")))
    texts, head = texts.where("raw <> ''"), F.substring_index("raw", BLANK_LINE, 1)
    field = lambda name: F.nullif(F.btrim(F.regexp_extract("head", rf"(?i)\r\n{name}:([^\r\n]*)", 1), F.lit(" \t")), F.lit(""))
    size = F.regexp_extract("head", r"(?i)\r\ncontent-length:[ \t]*([0-9]+)", 1).try_cast("int")
    cut = texts.select(head.alias("head"), F.substring(F.col("raw").cast("binary"), F.octet_length(head) + 5, F.octet_length("raw")).alias("rest"))
    block = F.substring("rest", F.lit(1), F.coalesce(size, F.lit(0)))
    named = cut.select(
        field("warc-record-id").alias("record_id"), F.lower(field("warc-type")).alias("type"), field("warc-date").alias("date"), field("warc-target-uri").alias("target_uri"),
        F.transform(F.regexp_extract_all("head", F.lit(r"(?i)\r\nwarc-concurrent-to:([^\r\n]*)"), F.lit(1)), lambda c: F.btrim(c, F.lit(" \t"))).alias("concurrent_to"),
        field("warc-refers-to").alias("refers_to"), field("warc-payload-digest").alias("declared_digest"), field("content-type").alias("content_type"), block.alias("block"),
    )
    http = F.coalesce(F.col("content_type").ilike("application/http%"), F.lit(False))
    skip = F.when(http, F.octet_length(F.substring_index(F.col("block").cast("string"), BLANK_LINE, 1)) + 5).otherwise(1)
    body = F.when(F.col("type").isin(*CAPTURES) & (F.col("type") != "revisit"), F.substring("block", skip, F.octet_length("block")))
    return named.withColumn("payload", body).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def _owners(records: DataFrame, scratch: Scratch) -> DataFrame:
    """record_id, capture: for every record that hangs together with a capture, the smallest identifier of one."""
    named = records.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id IS NOT NULL")
    links = named.union(named.select("other", "record_id"))
    found = records.where(F.col("type").isin(*CAPTURES)).select("record_id", F.col("record_id").alias("capture")).distinct()
    others = records.where(~F.col("type").isin(*CAPTURES)).select("record_id").distinct()
    frontier, owners = found, None
    while True:
        reach = links.join(frontier.withColumnRenamed("record_id", "other"), "other").join(others, "record_id", "left_semi")
        if owners is not None:
            reach = reach.join(owners, "record_id", "left_anti")
        frontier = scratch.write(reach.groupBy("record_id").agg(F.min("capture").alias("capture")))
        if owners is not None and frontier.isEmpty():
            return owners
        owners = frontier if owners is None else scratch.write(owners.union(frontier))
        if others.join(owners, "record_id", "left_anti").isEmpty():
            return owners


def assemble(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One nested row a capture: record_id, type, date, target_uri, the columns of its payload, refers_to, request and
    metadata struct<record_id,target_uri,block>, n_requests and n_metadata long. records: what read_records gives, with or
    without the payload."""
    slim = scratch.write(records.drop("payload"))
    owners = _owners(slim, scratch)
    parts = slim.where(F.col("type").isin("request", "metadata")).join(owners, "record_id", "left")
    of = lambda kind: F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "block"))
    nested = [F.min(of("request")).alias("request"), F.min(of("metadata")).alias("metadata"), F.count(of("request")).alias("n_requests"), F.count(of("metadata")).alias("n_metadata")]
    attached = parts.where("capture IS NOT NULL").groupBy(F.col("capture").alias("record_id")).agg(*nested)
    own = ["record_id", "type", "date", "target_uri", "refers_to", "declared_digest", *[c for c in ("payload", "payload_bytes", "payload_digest") if c in records.columns]]
    whole = records if "payload" in records.columns else slim
    captures = whole.where(F.col("type").isin(*CAPTURES)).select(*own).join(attached.hint("merge"), "record_id", "left")
    captures = captures.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_requests", "n_metadata")})
    kinds, one = dict(captures.dtypes), lambda kind: (F.col("type") == kind).cast("long").alias(f"n_{kind}s" if kind == "request" else f"n_{kind}")
    lost = parts.where("capture IS NULL").select(*[F.lit(None).cast(kinds[c]).alias(c) for c in own], of("request").alias("request"), of("metadata").alias("metadata"), one("request"), one("metadata"))
    return captures.unionByName(lost)


def with_originals(captures: DataFrame) -> DataFrame:
    """captures with original struct<record_id,metadata,payload_bytes,payload_digest>: the response that a revisit refers
    to, null for others and where it is not among them. captures: written, as they are read twice."""
    again = F.coalesce(F.col("type") == "revisit", F.lit(False))
    told = F.struct("record_id", "metadata", "payload_bytes", "payload_digest")
    firsts = captures.where(~again & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("_of")).agg(F.min(told).alias("original"))
    found = captures.where(again).join(firsts.hint("merge"), F.col("refers_to") == F.col("_of"), "left").drop("_of")
    return found.unionByName(captures.where(~again).withColumn("original", F.lit(None).cast(dict(found.dtypes)["original"])))


def pages_of(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of what write_archives wrote: the page, its whole
    payload, whether it is a response or revisits one, and the page it revisits."""
    page = lambda metadata: F.regexp_extract(metadata["block"].cast("string"), r"(?:^|\r\n)page_id: (-?[0-9]+)\r\n", 1).try_cast("long")
    said = F.regexp_replace("declared_digest", "^sha1:", "")
    again = F.col("type") == "revisit"
    return with_originals(captures).where(F.col("type").isNotNull()).select(
        page(F.col("metadata")).alias("page_id"), F.when(again, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, said).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("original.metadata")).alias("refers_to"),
    )


def archived_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) written as archives, read back and assembled, as pages_of tells them."""
    spark = pages.sparkSession
    with Scratch(spark, "warc") as scratch:
        path = f"{scratch.folder}/rounds/archives"
        write_archives(pages, path, scratch, least_bytes)
        captures = scratch.write(assemble(read_records(spark, path, scratch).drop("payload"), scratch))
        return scratch.keep(pages_of(captures))
