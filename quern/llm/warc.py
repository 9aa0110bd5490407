"""WARC archives: writing, reading, and assembly of transactions.

`write_archives` turns every page into three records: a request, a response or a
revisit, and a metadata record with the page's id and address as JSON; request and
metadata name the response in WARC-Concurrent-To.  Of pages with equal payloads
of `least` bytes or more, the one with the largest page_id is a response, and the
others revisit it.  Spark's text writer writes the records, gzipped, a blank line
apart, with a limit of records a file.

`read_records` reads archives with Spark's text reader, cut at the blank line
before a record's version, so that a task holds a record and not a file.  Since
payloads may contain such a line too, a record's Content-Length decides where it
ends: pieces of a file are joined again until it has that length.  Gzipped files
are read by one task each, so any payload is read right; a plain file may be read
in splits, and a record of it that a split cuts inside its payload is an error
(gzip such a file).  Ids, header names in any case, folded header lines and any
record types are read.

`transactions` joins request, response and metadata records through concurrent-to
identifiers in either direction, also over one record between (metadata to request
to response), and gives a nested row per capture.  A request or metadata record
without a response makes a capture of its own, without response, by the id it
names.  A revisit gets its original through WARC-Refers-To.

A null html is an empty payload.  A null page_id counts as smallest.  Repeated rows
are records of their own; one of them is the response.  An empty table gives empty
archives and no captures.  Texts of any length are kept whole.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, discard, lean, materialise, shared_dir, short_batches

GAP = "\r\n\r\n"
BETWEEN = f"{GAP}WARC/1."
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINCIPAL = ("response", "revisit", "resource", "conversion", "continuation")
RECORDS = """record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, content_type string, stated_digest string,
    http string, payload binary, payload_bytes long, payload_digest string"""


def base32(hexes: Column) -> Column:
    """Base32 of 40 hexadecimal digits, 20 bits a step."""
    parts = (F.lpad(F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, urn: Column, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    """A record's text.  A header whose value is null is left out."""
    lines = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", urn), ("WARC-Date", F.lit(DATE)), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    head = (F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in lines)
    return F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), block)


def urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and a key of the row: its place in its file.  Rows that come from elsewhere are written first."""
    columns, place = ("page_id", "url", "html"), F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("key")
    try:
        return pages.select(*columns, place)
    except AnalysisException:
        return materialise(pages.select(*columns)).select(*columns, place)


def write_archives(pages: DataFrame, path: str, least: int = 0, records_a_file: int = 30_000) -> None:
    """Writes all pages to `path`.  `pages` is a table as read, without generated rows, or any frame that has no file."""
    rows = keyed(pages).withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.unhex(F.sha2("html", 256)))
    equal = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "key")).alias("top"))
    equal = materialise(equal.where("n > 1").select("sha", F.col("top.key").alias("top"), F.lit(True).alias("repeated")))
    rows = rows.join(equal, "sha", "left")
    revisit = F.col("repeated") & (F.col("top") != F.col("key"))
    digest = F.concat(F.lit("sha1:"), base32(F.sha1("html")))
    me, uri = urn("response", F.col("key")), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(GAP))
    http, about = "application/http; msgtype=response", [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    response = record("response", me, http, F.concat(head, F.col("html")), *about)
    again = record("revisit", me, http, head, *about, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn("response", F.col("top"))))
    host = F.regexp_extract(uri, "^[A-Za-z]+://([^/?#]*)", 1)
    request = record("request", urn("request", F.col("key")), "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(GAP)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me))
    facts = F.to_json(F.struct("page_id", "url"))
    metadata = record("metadata", urn("metadata", F.col("key")), "application/json", facts, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me))
    records = rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    discard(equal)


def parsed(head: bytes) -> list[tuple[str, str]]:
    """(lower-case name, value) of the header lines; a line that begins with white space goes on."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    return [(name.strip().lower(), value.strip()) for name, _, value in (x.partition(":") for x in lines)]


def records_in(pieces: Iterable[tuple[tuple, bytes]]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records in the pieces (split, bytes) of files that were cut at BETWEEN."""
    split, held, need = None, bytearray(), 0

    def take(last: bool) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        nonlocal held, need
        while len(held) >= need:
            while held[:2] == b"\r\n":
                del held[:2]
            if not held:
                return
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            headers = parsed(bytes(held[:end]))
            if not held.startswith(b"WARC/") or not any(n == "content-length" for n, _ in headers):
                raise ValueError(f"no WARC record, or one that a split has cut: {bytes(held[:60])!r} in {split}")
            need = end + 4 + int(dict(headers)["content-length"])
            if len(held) < need:
                break
            yield headers, bytes(held[end + 4 : need])
            del held[:need]
            need = 0
        if last and held:
            raise ValueError(f"a record has no end, or a split has cut it: {bytes(held[:60])!r} in {split}")

    for at, piece in pieces:
        if at != split:
            yield from take(True)
            split, held, need = at, bytearray(), 0
            held += piece if at[1] == 0 else BETWEEN[4:].encode() + piece
        else:
            held += BETWEEN.encode() + piece
        yield from take(False)
    yield from take(True)


def row_of(headers: list[tuple[str, str]], block: bytes, payloads: bool) -> tuple:
    one = dict(reversed(headers))
    http, payload, kind = None, block, one.get("content-type")
    if (kind or "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kept = payload if payloads or one.get("warc-type") == "metadata" else None
    return (
        one.get("warc-record-id"), one.get("warc-type"), [v for n, v in headers if n == "warc-concurrent-to"], one.get("warc-refers-to"), one.get("warc-target-uri"), one.get("warc-date"),
        kind, one.get("warc-payload-digest"), http, kept, len(payload), digest,
    )


KINDS = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 6, pa.binary(), pa.int64(), pa.string()]
NAMES = [x.split()[0] for x in RECORDS.split(",")]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORDS of all archives in `path`.  Without `payloads`, only metadata records keep theirs; lengths and digests are of the whole payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple, bytes]]:
            for batch in batches:
                yield from zip(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()), as_bytes(batch.column(0)))

        held: list[tuple] = []
        size = 0
        for headers, block in records_in(pieces()):
            held.append(row_of(headers, block, payloads))
            size += len(block) if payloads else 1000
            if size > 8_000_000:
                yield made(held)
                held, size = [], 0
        yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], k) for i, k in enumerate(KINDS)], NAMES)

    text = spark.read.option("lineSep", BETWEEN).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).mapInArrow(lean(rows), RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """capture (the response's id), response, requests, metadata: one nested row per capture.  `records` are read more than once: give a written table."""
    body = F.struct(*NAMES)
    main = records.where(F.col("type").isin(*PRINCIPAL))
    others = records.where(~F.col("type").isin(*PRINCIPAL, "warcinfo"))
    ids = main.select(F.col("record_id").alias("capture"))
    named = others.select("record_id", F.explode("concurrent_to").alias("other"))
    back = main.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("other"))
    links = named.unionAll(back).distinct()
    direct = links.join(ids, F.col("other") == F.col("capture")).select("record_id", "capture")
    onward = direct.select(F.col("record_id").alias("other"), "capture")
    over_one = links.join(onward, "other").select("record_id", "capture")
    found = direct.unionAll(over_one).distinct()
    alone = F.coalesce(F.array_min("concurrent_to"), F.col("record_id"))
    joined = others.select("*", body.alias("body")).join(found, "record_id", "left").select(F.coalesce("capture", alone).alias("capture"), "type", "body")
    lists = (F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("body")))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata")))
    beside = joined.groupBy("capture").agg(*lists)
    whole = main.select(F.col("record_id").alias("capture"), body.alias("response")).join(beside, "capture", "full")
    return whole.select("capture", "response", *(F.coalesce(c, F.array()).alias(c) for c in ("requests", "metadata")))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """The query: pages go to archives, and page_id, payload_bytes, payload_digest, record_type, refers_to come from what is read back."""
    spark = pages.sparkSession
    short_batches(spark)
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    records = materialise(read_records(spark, path, payloads=False))
    about = F.from_json(F.col("metadata")[0]["payload"].cast("string"), "page_id long, url string")
    captures = materialise(transactions(records).where("response is not null").select("capture", "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest", about.alias("page")))
    originals = captures.where("type = 'response'").select(F.col("capture").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest"), F.col("page.page_id").alias("top"))
    again = captures.where("type = 'revisit'").join(originals, "refers_to", "left").select("page.page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "type", F.col("top").alias("refers_to"))
    first = captures.where("type <> 'revisit'").select("page.page_id", "payload_bytes", "payload_digest", "type", F.lit(None).cast("long").alias("refers_to"))
    out = materialise(first.unionAll(again).withColumnRenamed("type", "record_type"))
    written = spark.createDataFrame([], "x int")
    written.written_to = path
    discard(records, captures, written)
    return out


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
t AS (SELECT page_id, strlen(html) AS n, upper(sha1(html)) AS h, row_number() OVER w AS k, first_value(page_id) OVER w AS top FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM t
"""
