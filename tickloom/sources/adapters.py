"""The given tables as trades and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(events: DataFrame) -> DataFrame:
    """events as silver trades in doubles: symbol, trade_id, price, quantity, is_buyer_maker, trade_timestamp."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("quantity"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        F.col("ts").cast("timestamp").alias("trade_timestamp"),
    )


def raw_trades(events: DataFrame) -> DataFrame:
    """events as wire records: JSON in `value`, the symbol in `key`, and broker columns."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    body = F.struct(
        F.lit("trade").alias("e"), ms.alias("E"), F.col("event_type").alias("s"), F.col("event_id").alias("t"), F.col("value").cast("string").alias("p"),
        (F.get_json_object("props", "$.k").cast("int") + 1).cast("string").alias("q"), F.lit(0).alias("b"), F.lit(0).alias("a"), ms.alias("T"), (F.col("user_id") % 2 == 0).alias("m"), F.lit(True).alias("M"),
    )
    return events.select(
        F.col("event_type").cast("binary").alias("key"), F.to_json(body).cast("binary").alias("value"), F.lit("trades").alias("topic"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


def news(documents: DataFrame) -> DataFrame:
    """documents as raw articles, a minute apart."""
    published = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return documents.select(
        F.col("source"), F.col("doc_id").cast("string").alias("article_id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://news.example.org/"), F.col("doc_id").cast("string")).alias("url"), F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("crawled_at"), F.lit(None).cast("string").alias("author"), F.array("lang").alias("tags"), F.lit(None).cast("string").alias("content_hash"),
    )
