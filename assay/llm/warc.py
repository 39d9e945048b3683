"""WARC archives: writing with payload de-duplication, and reading by boundary-chain verification.

Writing: one record per page; of pages with equal payloads the smallest id is a ``response``, the others are ``revisit`` records that
refer to it and carry no payload. Records are written as text with the record separator between them, so every part file is an
archive, gzipped unless asked otherwise.

Reading: the files are split at every occurrence of the record magic, wherever it stands, by Spark's text source (in parallel
within a file that is not gzipped). Lengths of the fragments, summed up per block and file, give each occurrence its byte offset. Every one is
a candidate; its header's length fields give the offset where its successor must start. Pointer jumping from offset 0 follows these
links in doubling steps and keeps what it reaches; a magic inside a payload is never reached, and its fragment is put back into
the record around it. Only offsets take part; a record that is one fragment, as nearly all are, is taken apart where it is read, and
payloads move only if they are asked for or lie in several fragments. Everything is DataFrame functions.

Defined results: a null payload is empty; a null url is written empty; a page without an id refers to the response of its payload
if there is one, and is a response else; several pages with the smallest id are all responses; an empty table gives empty archives;
other columns are not read; payloads of any length are written and read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bind, saved, shared_path, tidy

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits make four digits of the result."""

    def digits(sha: Column) -> Column:
        groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
        return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    return bind(F.sha1(text.cast("binary")), digits)


def _urn(page: Column, digest: Column) -> Column:
    dashed = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), bind(F.md5(F.concat_ws("/", page.cast("string"), digest).cast("binary")), dashed), F.lit(">"))


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """What will be written: id, url, payload, its size and digest, record type and the id it refers to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    heads = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("head"))
    heads = saved(heads, "warc-heads").withColumnRenamed("payload_digest", "of")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(heads, (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") >= min_bytes), "left").select(
        *rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("head")).alias("refers_to"))


def record(date: str = DATE) -> Column:
    """A record without its separator, of the columns of ``plan``."""
    first = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK))
    block = F.when(first, F.concat(http, F.col("payload"))).otherwise(http)
    length = F.octet_length(http) + F.when(first, F.col("payload_bytes")).otherwise(F.lit(0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.translate(F.col("url"), "\r\n", "")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(~first, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest"))), line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"))
    return F.concat(head, block)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE, compression: str = "gzip") -> None:
    """Archives under ``path``, one per task."""
    records = plan(pages, id_col, url_col, payload_col, min_bytes).select(record(date).alias("value"))
    with tidy(pages.sparkSession):
        records.write.option("lineSep", BREAK).option("compression", compression).text(path)


# --- reading --------------------------------------------------------------------


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _payload(value: Column, header_chars: Column) -> Column:
    """The payload of a whole record: behind its own header and that of the response in it."""
    block = F.substring(value, header_chars + len(BREAK) + 1, F.length(value) - header_chars - 2 * len(BREAK))
    return bind(block, lambda b: F.substring(b, F.instr(b, BREAK) + len(BREAK), F.length(b)))


def _taken_apart(value: Column) -> Column:
    """Header fields of what follows a magic, whether it is exactly one record, and size and digest of the payload if so."""

    def fields(h: Column) -> Column:
        length = F.try_to_number(_field(h, "Content-Length"), F.lit("9" * 18))
        whole = F.coalesce(F.octet_length(value) == F.octet_length(h) + 2 * len(BREAK) + length, F.lit(False)) & F.endswith(value, F.lit(BREAK))
        said = F.struct(
            _field(h, "WARC-Type").alias("record_type"), _field(h, "WARC-Target-URI").alias("url"), _field(h, "X-Page-Id").try_cast("long").alias("page_id"),
            _field(h, "X-Refers-To-Page-Id").try_cast("long").alias("refers_to"), F.substring(_field(h, "WARC-Payload-Digest"), 6, 32).alias("digest"),
            _field(h, "X-Payload-Length").try_cast("long").alias("bytes"))
        facts = lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), base32_sha1(p).alias("digest"))
        found = F.when(whole & (_field(h, "WARC-Type") == "response"), bind(_payload(value, F.length(h)), facts))
        return F.struct(
            F.contains(value, F.lit(BREAK)).alias("has_header"), F.octet_length(h).alias("header_bytes"), F.length(h).alias("header_chars"),
            length.cast("long").alias("length"), whole.alias("whole"), said.alias("said"), found.alias("found"))

    return bind(F.substring_index(value, BREAK, 1), fields)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic up to the next one, in the order of the files: file, block, seq, size, value and its parts ``r``.
    Written once, so that offsets hold."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
        (F.octet_length("value") + len(MAGIC)).alias("size"), "value", bind(F.col("value"), _taken_apart).alias("r"))
    return saved(raw, "warc-fragments")


def places(raw: DataFrame) -> DataFrame:
    """Byte offset of the magic before every fragment: sizes summed up per block, and block totals per file."""
    blocks = raw.groupBy("file", "block").agg(F.sum("size").alias("size"))
    ahead = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = blocks.select("file", "block", F.coalesce(ahead, F.lit(0)).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    small = raw.select("file", "block", "seq", F.coalesce(inner, F.lit(0)).alias("inner"), F.col("r.has_header").alias("has_header"),
                       F.col("r.header_bytes").alias("header_bytes"), F.col("r.length").alias("length"), F.col("r.whole").alias("whole"))
    placed = small.join(bases, ["file", "block"]).withColumn("offset", F.col("base") + F.col("inner") - len(MAGIC))
    return saved(placed.where("offset >= 0").drop("block", "base", "inner"), "warc-places")


def candidates(placed: DataFrame) -> DataFrame:
    """Offsets of candidates and of the successors that their headers announce."""
    after = F.col("offset") + len(MAGIC) + F.col("header_bytes") + len(BREAK) + F.col("length") + len(BREAK)
    return placed.where("has_header AND length >= 0").select("file", "offset", after.alias("next"))


def reachable(links: DataFrame) -> DataFrame:
    """``file`` and ``offset`` of the records on the chain from each file's start: pointers double every turn, keys are unique."""
    links = jump = saved(links, "warc-links")
    reached = saved(links.where("offset = 0").select("file", "offset"), "warc-reached")
    parts = [reached]
    while True:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        onward = saved(found.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
                       .join(links.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-reached")
        if onward.isEmpty():
            return found
        parts.append(onward)
        second = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("last"))
        jump = saved(jump.join(second, ["file", "next"]).select("file", "offset", F.col("last").alias("next")), "warc-jumps")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, record_type, url, page_id, refers_to, payload (null for revisits), payload_bytes, payload_digest
    (recomputed where the payload is there, else as written) and ``intact``, whether both agree with the header."""
    raw = fragments(spark, path)
    placed = places(raw)
    starts = reachable(candidates(placed)).select("file", "offset", F.lit(True).alias("start"))
    begun = F.when(F.col("start"), F.struct(F.col("offset").alias("at"), "whole"))
    owner = F.last(begun, ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))  # small rows of one file
    owned = placed.join(starts, ["file", "offset"], "left").select("seq", "offset", owner.alias("owner")).where("owner IS NOT NULL")
    owned = saved(owned.select("seq", "offset", F.col("owner.at").alias("at"), F.col("owner.whole").alias("alone")), "warc-owned")
    one = raw.join(owned.where("alone AND offset = at"), "seq").select("file", "offset", "value", "r")
    split = saved(owned.where("NOT alone"), "warc-split")  # mostly none: by the size of this table Spark decides whether payloads move
    parts = raw.join(split, "seq").groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = parts.select("file", F.col("at").alias("offset"), F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    several = joined.select("file", "offset", "value", bind(F.col("value"), _taken_apart).alias("r"))
    r = lambda name: F.col(f"r.{name}")
    return one.unionByName(several).select(
        "file", "offset", r("said.record_type").alias("record_type"), r("said.url").alias("url"), r("said.page_id").alias("page_id"),
        r("said.refers_to").alias("refers_to"), F.when(r("found").isNotNull(), _payload(F.col("value"), r("header_chars"))).alias("payload"),
        F.coalesce(r("found.bytes"), r("said.bytes")).alias("payload_bytes"), F.coalesce(r("found.digest"), r("said.digest")).alias("payload_digest"),
        F.coalesce((r("found.bytes") == r("said.bytes")) & (r("found.digest") == r("said.digest")), r("said.record_type") == "revisit", F.lit(False)).alias("intact"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to the shared folder and read back: one row per page."""
    path = shared_path(pages.sparkSession, "warc-archives")
    write(pages, path, min_bytes=min_bytes)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
