"""WARC archives: writing with revisit records, and a salvage reader.

``write_archives`` writes one uncompressed record per page through Spark's
text sink, so archives can go to any file system Spark writes to. Of equal
payloads of at least ``MIN_REVISIT`` bytes, the page with the largest page_id
is a response, the others are revisits that refer to it and carry no payload;
only digests are grouped, payloads are never shuffled.

``read_archives`` reads whole archives, plain or with one gzip member per
record. A record is accepted if its version line, header, declared length,
closing line breaks and payload digest all check. After a failed check the
reader looks for the next version line (or gzip member), goes on there, and
reports the skipped bytes as a gap. An archive is one task's work, so the
writer bounds an archive's records and bytes.

Defined results: null html is the empty payload. Rows that share a page_id
are told apart by a record id of their own; among equal payloads with the
same largest page_id the record with the greatest url (nulls first) is the
response. A null page_id is below every other. Repeated rows are one record
each. A revisit whose response is lost has null refers_to and null length.
Line breaks in a url are percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import map_rows, saved, shared_path

MIN_REVISIT = 1000            # bytes of payload from which repeats become revisits
RECORDS_PER_ARCHIVE = 1000    # an archive is read whole by one task
BYTES_PER_ARCHIVE = 1 << 26   # likewise; one longer record is an archive of its own
#: Fixed values of the format.
VERSION = "WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def header(*fields: tuple[str, Column | str | None]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")), F.lit("")) for k, v in fields], F.lit("\r\n"))


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One WARC record per page as a string without its closing line breaks, in column ``value``."""
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    rank = F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"))
    repeated = saved(rows.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.max(rank).alias("top"), F.count("*").alias("times"))
                     .filter("times > 1"), "repeated")
    rows = rows.join(repeated.select("digest", "top"), "digest", "left")
    own = F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"))
    rows = rows.withColumn("revisit", F.col("top").isNotNull() & ~own.eqNullSafe(F.col("top")))
    record_id = lambda page_id, url: F.concat(F.lit("<urn:sha1:"), F.sha1(F.to_json(F.struct(page_id.alias("p"), url.alias("u"))).cast("binary")), F.lit(">"))
    body = F.when(F.col("revisit"), F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    size = F.when(F.col("revisit"), F.lit(len(HTTP))).otherwise(F.col("n") + len(HTTP))
    top = F.when(F.col("revisit"), record_id(F.col("top.page_id"), F.col("top.url")))
    return rows.select(F.concat(header(
        ("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("page_id").cast("long"), F.col("url"))),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", F.col("url")),
        ("Page-ID", F.col("page_id").cast("string")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", top),
        ("Refers-To-Page-ID", F.when(F.col("revisit"), F.col("top.page_id").cast("string"))),
        ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", size.cast("string"))), body).alias("value"))


def in_archives(rows: DataFrame, per_archive: int, max_bytes: int) -> DataFrame:
    """Records (value) with the number, within their task, of the archive that they go to; numbers ascend."""
    def run(batches):
        archive = n = used = 0
        for b in batches:
            numbers = []
            for size in pc.binary_length(b.column(0)).to_pylist():
                size += len(END)
                if n == per_archive or n and used + size > max_bytes:
                    archive, n, used = archive + 1, 0, 0
                n, used = n + 1, used + size
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int32())], names=["value", "archive"])

    return rows.mapInArrow(run, "value string, archive int")


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, per_archive: int = RECORDS_PER_ARCHIVE,
                   max_bytes: int = BYTES_PER_ARCHIVE) -> None:
    """Write the pages under ``path`` as archives of at most ``per_archive`` records and ``max_bytes`` bytes, or one longer record."""
    rows = in_archives(records(pages, min_revisit), per_archive, max_bytes)
    rows.write.partitionBy("archive").option("lineSep", END).text(path)


VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"


class Bad(ValueError):
    """A record failed a check."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a version line and the offset behind it."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Bad("no end of header")
    fields = {}
    for x in data[line.end():end].split(b"\r\n"):
        if not x:
            continue
        name, colon, value = x.partition(b":")
        if not colon:
            raise Bad("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise Bad("no content length")
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Bad("the block does not end where its length says")
    block = data[start:stop]
    _, split, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"-", block)
    if not split:
        raise Bad("no HTTP header")
    if fields.get("warc-type") != "revisit" and not digest_holds(fields.get("warc-payload-digest"), payload) \
            or not digest_holds(fields.get("warc-block-digest"), block):
        raise Bad("digest differs")
    return {"fields": fields, "payload": payload}, stop + 4


def digest_holds(stated: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1, in hex or base32, is that of the data; other or no digests are not checked."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower() != "sha1":
        return True
    found = hashlib.sha1(data).digest()
    return value.lower() == found.hex() or value.upper() == base64.b32encode(found).decode()


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) for each good record and (offset, length, None, reason) for each gap."""
    at, gap, reason = 0, None, None
    while at < len(data):
        try:
            record, end = member(data, at) if data.startswith(GZIP, at) else parse_record(data, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            line, zipped = VERSION_LINE.search(data, at + 1), data.find(GZIP, at + 1)
            at = min(x for x in (line.start() if line else len(data), zipped if zipped >= 0 else len(data)))
            continue
        if gap is not None:
            yield gap, at - gap, None, reason
            gap = None
        yield at, end - at, record, None
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, reason


def member(data: bytes, at: int) -> tuple[dict, int]:
    """The one record in the gzip member at an offset, and the offset behind the member."""
    stream, parts, read = zlib.decompressobj(31), [], at
    try:
        while not stream.eof and read < len(data):
            parts.append(stream.decompress(data[read:read + (1 << 16)]))
            read = min(len(data), read + (1 << 16))
    except zlib.error as e:
        raise Bad("damaged gzip member") from e
    if not stream.eof:
        raise Bad("cut gzip member")
    plain = b"".join(parts)
    record, end = parse_record(plain, 0)
    if end != len(plain):
        raise Bad("more than a record in a gzip member")
    return record, read - len(stream.unused_data)


READ = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("gap", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("refers_to_record", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("refers_to_page", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record, and one per gap with its reason in ``gap``; a response's length and digest are those of the bytes read."""
    def per_batch(batch):
        out = {f.name: [] for f in READ}
        for archive, data in zip(batch["path"], batch["content"], strict=True):
            for offset, length, record, reason in salvage(data):
                f, body = (record["fields"], record["payload"]) if record else ({}, None)
                held = record and f.get("warc-type") != "revisit"
                row = (archive, offset, length, reason, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), number(f.get("page-id")),
                       number(f.get("refers-to-page-id")), len(body) if held else None, hashlib.sha1(body).hexdigest() if held else None,
                       body if held and payloads else None)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
        return out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_rows(files, READ, per_batch)


def number(x: str | None) -> int | None:
    """A BIGINT, or null for anything else."""
    return int(x) if x and re.fullmatch("-?[0-9]{1,19}", x) and -(1 << 63) <= int(x) < 1 << 63 else None


def resolved(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; revisits take size and digest from the response they refer to."""
    found = read.filter("gap is null")
    responses = found.filter("record_type = 'response'")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    origin = found.filter("record_type = 'revisit'").select("refers_to_record").distinct() \
        .join(responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("origin"), "payload_bytes", "payload_digest"), "refers_to_record") \
        .dropDuplicates(["refers_to_record"])
    revisits = found.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record").join(origin, "refers_to_record", "left")
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")) \
        .union(revisits.select(*columns, F.col("origin").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and resolve revisits."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    read = saved(read_archives(spark, path, payloads=False).drop("payload"), "warc-records")
    return resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: the same from the pages alone.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM t
"""
