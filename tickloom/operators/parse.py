"""Parsing, typing and filtering of trades and news (bronze and silver)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import text as T
from tickloom.schemas import MONEY, RAW_NEWS
from tickloom.sources.feeds import TRADE_FIELDS, json_rows


def broker_columns(df: DataFrame) -> list[Column]:
    return [F.col("key").cast("string").alias("kafka_key"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp")]


def bronze_trades(messages: DataFrame) -> DataFrame:
    rows = json_rows(messages, F.col("value").cast("string"), TRADE_FIELDS, *broker_columns(messages))
    return rows.withColumns({"ingested_at": F.current_timestamp(), "trade_date": F.to_date(F.timestamp_millis("trade_time_ms"))})


def bronze_news(messages: DataFrame) -> DataFrame:
    rows = messages.select(F.from_json(F.col("value").cast("string"), RAW_NEWS).alias("n"), *broker_columns(messages)).select("n.*", "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")
    return rows.withColumns({"ingested_at": F.current_timestamp(), "publish_date": F.to_date(F.try_to_timestamp(F.col("published_at")))})


def valid_trades(trades: DataFrame) -> DataFrame:
    return trades.dropna(subset=["trade_id", "symbol", "price", "quantity"])


def side(is_buyer_maker: Column) -> Column:
    """The aggressor: SELL if the buyer was the maker, else BUY (unknown too)."""
    return F.when(is_buyer_maker, "SELL").otherwise("BUY")


def silver_trades(bronze: DataFrame) -> DataFrame:
    """Valid trades with timestamps and exact decimals; prices that are no numbers become NULL and go."""
    typed = valid_trades(bronze).withColumns({"price": F.col("price").try_cast(MONEY), "quantity": F.col("quantity").try_cast(MONEY)})
    return valid_trades(typed).select(
        "trade_id", "symbol", "price", "quantity", (F.col("price") * F.col("quantity")).alias("quote_quantity"), side(F.col("is_buyer_maker")).alias("side"),
        F.timestamp_millis("trade_time_ms").alias("trade_timestamp"), F.timestamp_millis("event_time_ms").alias("event_timestamp"), "buyer_order_id", "seller_order_id",
        "trade_date", "ingested_at", F.current_timestamp().alias("processed_at"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def distinct_trades(trades: DataFrame, ingested: str = "ingested_at") -> DataFrame:
    """The latest version of each trade; ids count within their symbol."""
    return latest_per_key(trades, ["symbol", "trade_id"], [F.col(ingested).desc()])


def good_news(news: DataFrame, title: int = 10, content: int = 50) -> DataFrame:
    """Articles with an id whose raw title and content are longer than so many characters."""
    return news.dropna(subset=["article_id", "title", "content"]).filter((F.length("title") > title) & (F.length("content") > content))


def silver_news(bronze: DataFrame, symbols: tuple[str, ...] = T.SYMBOLS, names: dict[str, str] = T.NAMES) -> DataFrame:
    rows = good_news(bronze).withColumns({"title": T.cleaned(F.col("title")), "content": T.cleaned(F.col("content"))})
    return rows.select(
        "article_id", "source", "title", "content", "url", "author", "tags",
        F.try_to_timestamp(F.col("published_at")).alias("published_timestamp"), F.try_to_timestamp(F.col("crawled_at")).alias("crawled_timestamp"),
        T.mentions(F.concat_ws(" ", "title", "content"), symbols, names).alias("mentioned_symbols"), T.word_count(F.col("content")).alias("word_count"),
        T.content_hash(F.col("title"), F.col("content"), F.col("content_hash")).alias("content_hash"), F.to_date(F.try_to_timestamp(F.col("published_at"))).alias("publish_date"),
    )


def distinct_news(news: DataFrame, order: str = "crawled_timestamp") -> DataFrame:
    """The latest crawl of each content; the id decides ties."""
    return latest_per_key(news, ["content_hash"], [F.col(order).desc(), F.col("article_id")])


def first_seen_news(sources: list[DataFrame], seen: str = "crawled_timestamp") -> DataFrame:
    """All sources together, each content once, as first seen."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    return latest_per_key(union, ["content_hash"], [F.col(seen), F.col("article_id")])


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `violations`, the names of the rules that a row breaks (a rule that is unknown is broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_checked(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with the reasons)."""
    both = checked(df, rules)
    return both.filter(F.size("violations") == 0).drop("violations"), both.filter(F.size("violations") > 0)


def within_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    return df.filter(F.col(column) <= F.lit(end).cast("date")) if end else df


def from_source(news: DataFrame, part: str) -> DataFrame:
    return news.filter(F.lower("source").contains(part.lower()))
