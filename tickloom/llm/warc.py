"""WARC archives: writing captures as records, reading them back, assembling transactions.

Writing is DataFrame expressions and Spark's text writer: a record is one row, and the line separator
is the two CRLF that end a record, so the files are (gzipped) WARC files, committed by Spark and split by it.
Reading walks each archive by Content-Length. Assembly joins request, response (or revisit) and metadata
records through WARC-Concurrent-To and gives one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, written

CRLF = "\r\n"
RECORD_END = CRLF * 2
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one archive file at most; an archive is read by one task.
RECORDS_PER_FILE = 6000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hex digest of 5-byte multiples (SHA-1: 40 hex digits to 32 letters), 20 bits at a time."""
    letters = F.lit(BASE32)

    def part(k: Column) -> Column:
        bits = F.conv(F.substr(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substr(letters, F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), part), "")


def with_decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null: it is a response), ordinal.

    Of equal payloads of `least_bytes` or more the largest page_id is the response. The digests of a hot
    payload shrink to one row a task before the shuffle; the join back reads ids and digests only, and
    payloads are joined by page, which is even.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    seen = written(rows.select("page_id", "digest", "n_bytes"), "payload-digests")
    groups = seen.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = written(seen.join(groups, "digest").filter("page_id < largest").select("page_id", "digest", F.col("largest").alias("refers_to")).distinct(), "revisits")
    ordinal = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    return rows.join(revisits, ["page_id", "digest"], "left").withColumn("ordinal", ordinal)


def write_archives(pages: DataFrame, out: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """A request, a response or revisit, and a metadata record for every row of `pages`.

    Null html is an empty payload; line breaks in a url become spaces; rows that repeat a page_id and its
    payload are numbered, so each is a capture.
    """
    rows = with_decisions(pages, least_bytes)
    name = lambda page, n, kind: F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(":"), n.cast("string"), F.lit(f":{kind}>"))
    own = name(F.col("page_id"), F.col("ordinal"), "response")
    uri = F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(RECORD_END))

    def record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
        known = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) for k, v in [("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Date", F.lit(date)), *fields]]
        return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(CRLF), F.array_join(F.array_compact(F.array(*known)), ""), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END), block)

    response = record(
        F.when(revisit, "revisit").otherwise("response"),
        own,
        [
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, name(F.col("refers_to"), F.lit(1), "response"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    path = F.coalesce(F.nullif(F.regexp_extract(uri, "^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(uri, "^[a-zA-Z]+://([^/]*)", 1)
    request = record(F.lit("request"), name(F.col("page_id"), F.col("ordinal"), "request"), [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(RECORD_END)))
    metadata = record(F.lit("metadata"), name(F.col("page_id"), F.col("ordinal"), "metadata"), [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payloadBytes: "), F.col("n_bytes").cast("string"), F.lit(CRLF)))
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(out, compression="gzip")


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


#: Bytes of an archive that are unpacked at once, and of records that are passed on at once.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 16 << 20


def unpacked(archive: bytes) -> Iterator[bytes]:
    """An archive's bytes in pieces, out of any number of gzip members or none."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(archive), CHUNK_BYTES):
        rest = archive[at : at + CHUNK_BYTES]
        while rest:
            yield member.decompress(rest)
            rest = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record; one record and one piece of the archive are held at a time."""
    held, pieces = bytearray(), unpacked(archive)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if (piece := next(pieces, None)) is None:
                return
            held += piece
        fields = fields_of(bytes(held[:end]))
        start = end + 4
        stop = start + int(fields["content-length"])
        while len(held) < stop + len(RECORD_END) and (piece := next(pieces, None)) is not None:
            held += piece
        yield fields, bytes(held[start:stop])
        del held[: stop + len(RECORD_END)]


RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, block string, payload binary"


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row a record. Sizes and digests of responses are taken from their payload, those of revisits
    (which store none) from their header fields. `block` holds requests and metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for f, block in records(archive.as_py()):
                    kind, n, digest, text, payload = f["warc-type"], None, None, None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode("ascii")
                        payload = body if keep_payload else None
                    elif kind == "revisit":
                        n, digest = int(fields_of(block)["content-length"]), f["warc-payload-digest"].partition(":")[2]
                    else:
                        text = block.decode("utf-8", "replace")
                    rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), n, digest, text, payload))
                    size += 200 + len(text or "") + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def transactions(parsed: DataFrame) -> DataFrame:
    """One nested row a capture: response (or revisit), with its request and metadata or null."""
    capture = parsed.filter(F.col("record_type").isin("response", "revisit"))
    capture = capture.select("record_id", F.struct(*[c for c in parsed.columns if c not in ("concurrent_to", "block")]).alias("response"))

    def side(kind: str) -> DataFrame:
        return parsed.filter(F.col("record_type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "target_uri", "block").alias(kind))

    return capture.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:capture:([^:]*):", 1).try_cast("long")


def archive_digest(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Writes all pages to archives and reads them back, one row a capture.

    Defined cases: null html is an empty payload; equal payloads under one page_id are all responses; null
    page_ids are responses with a null id; an empty table gives no row; other columns are not read.
    """
    spark = pages.sparkSession
    out = out or scratch(spark, "archives")
    write_archives(pages.select("page_id", "url", "html"), out)
    captures = transactions(written(read_records(spark, out, keep_payload=False), "warc-records"))
    return captures.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )
