import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.sources import feeds, files


def payloads(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


TRADE = {"e": "trade", "E": 1700000000000, "s": "BTCUSDT", "t": 12345, "p": "50000.50", "q": "0.001", "b": 100, "a": 200, "T": 1700000000001, "m": False, "M": True}


def test_stream_trades(spark):
    broken = {**TRADE, "p": None}
    df = payloads(spark, json.dumps(TRADE), json.dumps({"stream": "btcusdt@trade", "data": TRADE}), json.dumps({**TRADE, "e": "depth"}), "no json", json.dumps(broken), None)
    got = feeds.stream_trades(df).collect()
    assert len(got) == 2 and got[0] == got[1] and (got[0].event_time_ms, got[0].trade_time_ms, got[0].trade_id, got[0].is_buyer_maker) == (1700000000000, 1700000000001, 12345, False)


def test_rest_trades(spark):
    df = spark.createDataFrame([("A", 1, "2.5", "3", 1700000000000, True, None)], "symbol string, id long, price string, qty string, time long, isBuyerMaker boolean, isBestMatch boolean")
    r = feeds.rest_trades(df).first()
    assert (r.symbol, r.trade_id, r.buyer_order_id, r.is_best_match) == ("A", 1, 0, True)


def test_nested_feed(spark):
    item = {"_id": "x1", "display_date": "2024-01-02T03:04:05Z", "canonical_url": "/a", "headlines": {"basic": "H"}, "description": {"basic": "D"}, "credits": {"by": [{"name": "Ann"}]}, "taxonomy": {"tags": [{"text": "t1"}, {"text": "t2"}]}}
    bare = {"_id": "x2", "display_date": "2024-01-02T03:04:05Z"}
    r, b = feeds.nested_articles(payloads(spark, json.dumps({"content_elements": [item, bare, {"_id": "undated"}]})), "a", "https://a.example.org").orderBy("article_id").collect()
    assert (r.article_id, r.title, r.url, r.author, r.tags, r.published_at) == ("x1", "H", "https://a.example.org/a", "Ann", ["t1", "t2"], dt.datetime(2024, 1, 2, 3, 4, 5))
    assert (b.title, b.author, b.tags) == ("", None, [])


def test_rss_feed(spark):
    item = "<item><guid>g{0}</guid><title>T{0}</title><description>D</description><link>L</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item>"
    r = feeds.rss_articles(payloads(spark, "<rss><channel><title>c</title>" + item.format(1) + item.format(2) + "</channel></rss>"), "b").orderBy("article_id").collect()
    assert [x.article_id for x in r] == ["g1", "g2"] and r[0].published_at == dt.datetime(2024, 1, 2, 2, 4, 5)


def test_flat_feed_and_since(spark):
    df = feeds.flat_articles(payloads(spark, json.dumps({"Data": [{"id": "7", "title": "T", "body": "B", "url": "u", "published_on": 1704067200, "categories": "X|Y"}, {"id": "8"}]})), "c")
    r = df.filter("article_id = '7'").first()
    assert r.tags == ["X", "Y"] and r.published_at == dt.datetime(2024, 1, 1)
    since = lambda m, o: [x.article_id for x in feeds.published_since(df, F.lit(f"2024-01-01 00:0{m}:00").cast("timestamp"), o).collect()]
    assert since(4, "5 minutes") == ["7"] and since(4, "3 minutes") == []


def test_backfill(spark, tmp_path):
    lines = [json.dumps({**TRADE, "t": k, "T": 1700000000000 + 86400000 * k}) for k in range(4)]
    (tmp_path / "in.json").write_text("\n".join(lines))
    got = files.backfill_trades(spark, f"{tmp_path}/in.json", f"{tmp_path}/out", "2023-11-15", "2023-11-16")
    assert sorted(r.trade_id for r in got.collect()) == [1, 2]
    back = files.read_table(spark, f"{tmp_path}/out", "symbol = 'BTCUSDT' AND trade_id = 2")
    assert back.count() == 1 and back.first().kafka_topic is None


def test_overwrite_replaces_partitions_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "p string, v int")
    files.write_table(df, f"{tmp_path}/t", ["p"], "overwrite")
    files.write_table(spark.createDataFrame([("b", 2)], "p string, v int"), f"{tmp_path}/t", ["p"], "overwrite")
    assert sorted((r.p, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("b", 2)]


def test_messages(spark):
    df = spark.createDataFrame([("A", 1, None)], "symbol string, n int, x string")
    r = files.messages(df, F.col("symbol"), {"kind": "trade"}).first()
    assert bytes(r.key) == b"A" and json.loads(bytes(r.value)) == {"symbol": "A", "n": 1} and (r.headers[0].key, bytes(r.headers[0].value)) == ("kind", b"trade")


def test_schema_evolution_on_read(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/t/k=1")
    spark.range(2).withColumn("more", F.lit("x")).write.parquet(f"{tmp_path}/t/k=2")
    df = files.read_table(spark, f"{tmp_path}/t", merge_schema=True)
    assert set(df.columns) == {"id", "more", "k"} and df.filter("more IS NULL").count() == 2


def test_broker_settings_are_passed_on(spark):
    """Without the broker's package Spark says so, and only then: all settings were taken."""
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException, match="(?i)kafka"):
        files.kafka_stream(spark, "localhost:9", "trades", 10, startingOffsets="earliest")
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        files.publish(files.messages(spark.range(3), F.col("id")), "localhost:9", "trades", {"kafka.security.protocol": "SASL_SSL"})


def test_message_batches_are_bounded(spark):
    sent = files.messages(spark.range(1000).withColumn("x", F.lit("y" * 50)), F.col("id"))
    batches = files.in_batches(sent, 2000)
    assert batches.agg(F.sum("n"), F.max("bytes")).first()[0] == 1000 and batches.agg(F.max("bytes")).first()[0] <= 2000
    assert sorted(int(bytes(k)) for r in batches.collect() for k in r["keys"]) == list(range(1000))
