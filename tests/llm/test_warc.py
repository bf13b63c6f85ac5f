import base64
import hashlib

from pyspark.sql import functions as F

from tickloom.llm import warc

PAGES = [
    (1, "http://a.example.org/x", "<p>same</p>"),
    (2, "http://b.example.org/", "<p>same</p>"),
    (3, None, None),
    (4, "not a url\r\nWARC-Type: fake", ""),
    (5, "https://c.example.org/é?q=1", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\ntail\r\n\r\n"),
    (6, "u", "é中\U0001f600" * 4000),
    (6, "u", "é中\U0001f600" * 4000),
    (7, "u", "é中\U0001f600" * 4000),
    (7, "v", "é中\U0001f600" * 4000),
    (None, "u", "no id"),
]


def test_round_trip_and_assembly(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    want, largest = [], {}
    for page, _, html in PAGES:
        largest[html or ""] = max(largest.get(html or "", page or -1), page or -1)
    for page, _, html in PAGES:
        b = (html or "").encode()
        again = page is not None and page < largest[html or ""]
        want.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", largest[html or ""] if again else None, True, True))
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted(map(tuple, warc.archive_digest(df).collect()), key=key) == sorted(want, key=key)
    assert warc.archive_digest(df.limit(0)).collect() == []


def test_payloads_come_back_whole(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a", least_bytes=10**9)
    got = warc.transactions(warc.read_records(spark, f"file://{tmp_path}/a")).collect()
    assert sorted(r.response.payload.decode() for r in got) == sorted(h or "" for _, _, h in PAGES)
    assert all(r.response.record_type == "response" and r.request.block.startswith("GET /") and "payloadBytes" in r.metadata.block for r in got)


def test_archives_of_several_members_and_long_records():
    import gzip

    long = b"x\r\n\r\ny" * 700_000
    made = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"one", long, b"", "é".encode() * 100_000)]
    for archive in (b"".join(made), b"".join(map(gzip.compress, made)), gzip.compress(b"".join(made)), gzip.compress(b"")):
        got = [b for _, b in warc.records(archive)]
        assert got == ([b"one", long, b"", "é".encode() * 100_000] if len(archive) > 100 else [])
