"""Payloads of feeds, one payload a row in `value`, to trades and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import RAW_TRADE, REST_TRADE


def json_rows(rows: DataFrame, value: Column, fields: dict[str, tuple[str, str]], *keep: Column) -> DataFrame:
    """Columns name: type out of a JSON object in each row, which is parsed once, and the `keep` columns. Keys that differ
    in case only stay apart; what is no JSON gives NULLs."""
    parsed = rows.select(*keep, F.json_tuple(value, *[k for k, _ in fields.values()]).alias(*fields))
    kept = [c for c in parsed.columns if c not in fields]
    return parsed.select(*[F.col(name).try_cast(kind).alias(name) for name, (_, kind) in fields.items()], *kept)


#: Name: (key in the message, type).
TRADE_FIELDS = {
    "event_type": ("e", "string"), "event_time_ms": ("E", "long"), "symbol": ("s", "string"), "trade_id": ("t", "long"), "price": ("p", "string"), "quantity": ("q", "string"),
    "buyer_order_id": ("b", "long"), "seller_order_id": ("a", "long"), "trade_time_ms": ("T", "long"), "is_buyer_maker": ("m", "boolean"),
}


def stream_trades(payloads: DataFrame) -> DataFrame:
    """Trade events, in the stream's envelope {"stream", "data"} or bare; others and broken ones go."""
    text = F.col("value").cast("string")
    body = F.coalesce(F.get_json_object(text, "$.data"), text)
    rows = json_rows(payloads.select(body.alias("_b")), F.col("_b"), TRADE_FIELDS)
    return rows.filter((F.col("event_type") == "trade") & F.col("symbol").isNotNull() & F.col("trade_id").isNotNull() & F.col("price").isNotNull() & F.col("quantity").isNotNull())


def rest_trades(trades: DataFrame) -> DataFrame:
    """REST trades of a symbol in the shape of events; they carry no order ids."""
    return trades.select(
        F.lit("trade").alias("event_type"), F.col("time").alias("event_time_ms"), "symbol", F.col("id").alias("trade_id"), "price", F.col("qty").alias("quantity"), F.lit(0).cast("long").alias("buyer_order_id"),
        F.lit(0).cast("long").alias("seller_order_id"), F.col("time").alias("trade_time_ms"), F.col("isBuyerMaker").alias("is_buyer_maker"), F.coalesce("isBestMatch", F.lit(True)).alias("is_best_match"),
    )


NESTED = (
    "content_elements array<struct<_id: string, display_date: string, canonical_url: string, headlines: struct<basic: string>, description: struct<basic: string>, "
    "credits: struct<by: array<struct<name: string>>>, taxonomy: struct<tags: array<struct<text: string>>>>>"
)


def nested_articles(payloads: DataFrame, source: str, base_url: str) -> DataFrame:
    item = payloads.select(F.explode(F.from_json(F.col("value").cast("string"), NESTED)["content_elements"]).alias("i")).select("i.*")
    return item.select(
        F.lit(source).alias("source"), F.coalesce("_id", F.lit("")).alias("article_id"), F.coalesce("headlines.basic", F.lit("")).alias("title"), F.coalesce("description.basic", F.lit("")).alias("content"),
        F.concat(F.lit(base_url), F.coalesce("canonical_url", F.lit(""))).alias("url"), F.try_to_timestamp(F.col("display_date")).alias("published_at"), F.get(F.col("credits.by"), 0)["name"].alias("author"),
        F.coalesce(F.transform("taxonomy.tags", lambda t: F.coalesce(t["text"], F.lit(""))), F.array().cast("array<string>")).alias("tags"),
    ).filter("published_at IS NOT NULL")


RSS = "channel struct<item: array<struct<guid: string, title: string, description: string, link: string, pubDate: string>>>"


def rss_articles(payloads: DataFrame, source: str) -> DataFrame:
    """Items of RSS documents. The weekday of pubDate says nothing new and cannot be parsed, so it is cut off."""
    item = payloads.select(F.explode(F.from_xml(F.col("value").cast("string"), RSS)["channel"]["item"]).alias("i")).select("i.*")
    date = F.regexp_replace(F.trim("pubDate"), "^[A-Za-z]+, *", "")
    text = lambda c: F.coalesce(c, F.lit(""))
    return item.select(
        F.lit(source).alias("source"), text(F.col("guid")).alias("article_id"), text(F.col("title")).alias("title"), text(F.col("description")).alias("content"), text(F.col("link")).alias("url"),
        F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"), F.lit(None).cast("string").alias("author"), F.array().cast("array<string>").alias("tags"),
    ).filter("published_at IS NOT NULL")


FLAT = "Data array<struct<id: string, title: string, body: string, url: string, published_on: long, categories: string>>"


def flat_articles(payloads: DataFrame, source: str) -> DataFrame:
    item = payloads.select(F.explode(F.from_json(F.col("value").cast("string"), FLAT)["Data"]).alias("i")).select("i.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return item.select(
        F.lit(source).alias("source"), text("id").alias("article_id"), text("title").alias("title"), text("body").alias("content"), text("url").alias("url"),
        F.timestamp_seconds(F.coalesce("published_on", F.lit(0))).alias("published_at"), F.lit(None).cast("string").alias("author"), F.split(text("categories"), r"\|").alias("tags"),
    )


def published_since(articles: DataFrame, since: Column, overlap: str = "0 minutes") -> DataFrame:
    """Articles from `since` less an overlap on."""
    return articles.filter(F.col("published_at") >= since - F.expr(f"INTERVAL {overlap}"))


#: Used by readers of files with these records.
SCHEMAS = {"trade": RAW_TRADE, "rest trade": REST_TRADE}
