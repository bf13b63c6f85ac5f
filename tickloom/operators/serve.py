"""Serving queries over bars, alerts and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numbers import direction


def latest(df: DataFrame, keys: list[str], time: str = "window_start") -> DataFrame:
    """The newest row of each key: a partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), time).alias("r")).select("r.*")


def history(bars: DataFrame, symbol: str, interval: str, n: int = 60) -> DataFrame:
    if not 1 <= n <= 1000:
        raise ValueError("n must lie in 1..1000")
    return bars.filter((F.col("symbol") == symbol) & (F.col("interval") == interval)).orderBy(F.col("window_start").desc()).limit(n)


def alerts(found: DataFrame, symbol: str | None = None, since: str | None = None, until: str | None = None, severity: float = 0.0, n: int = 100) -> DataFrame:
    """Newest alerts of a symbol, within times, from a severity on."""
    if symbol:
        found = found.filter(F.col("symbol") == symbol)
    if since:
        found = found.filter(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    if until:
        found = found.filter(F.col("detected_at") <= F.lit(until).cast("timestamp"))
    return found.filter(F.col("severity") >= severity).orderBy(F.col("detected_at").desc(), "symbol").limit(n)


def of_symbols(df: DataFrame, listed: str, at_most: int = 20) -> DataFrame:
    """Rows of the symbols in a comma-separated list."""
    names = [x.strip().upper() for x in listed.split(",") if x.strip()][:at_most]
    return df.filter(F.upper("symbol").isin(names))


def newest_articles(news: DataFrame, n: int = 30, body: int = 200) -> DataFrame:
    rows = news.orderBy(F.col("published_at").desc(), F.col("article_id")).limit(n)
    return rows.select("article_id", "title", F.substring("content", 1, body).alias("body"), "source", F.slice("tags", 1, 3).alias("categories"), "published_at")


def market_stats(latest_bars: DataFrame) -> DataFrame:
    mean = F.avg("price_change_pct")
    return latest_bars.agg(F.sum("volume").alias("total_volume"), F.sum("trade_count").alias("total_trades"), mean.alias("mean_change"), F.when(mean > 1, "Bullish").when(mean < -1, "Bearish").otherwise("Neutral").alias("sentiment"))


def market_overview(bars: DataFrame, predictions: DataFrame, found: DataFrame, since: str, until: str) -> DataFrame:
    """A row per symbol: newest bar, newest prediction, recent alerts, and the counts over all symbols."""
    now = latest(bars, ["symbol"]).select("symbol", F.col("close").alias("price"), F.col("price_change_pct").alias("change_pct"), "volume")
    said = latest(predictions, ["symbol"]).select("symbol", F.col("signal_direction").alias("prediction"), F.col("signal_strength").alias("confidence"))
    recent = found.filter((F.col("detected_at") >= F.lit(since).cast("timestamp")) & (F.col("detected_at") <= F.lit(until).cast("timestamp"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("recent_anomalies"))
    rows = now.join(said, "symbol", "left").join(recent, "symbol", "left").withColumn("recent_anomalies", F.coalesce("recent_anomalies", F.lit(0)))
    every = Window.partitionBy()  # one row a symbol by now
    count = lambda d: F.sum(F.when(F.col("prediction") == d, 1).otherwise(0)).over(every)
    return rows.withColumns({"bullish_count": count("UP"), "bearish_count": count("DOWN")})


def ingestion_summary(rows: DataFrame, valid, key: list[str]) -> DataFrame:
    """Fetched, valid, duplicate and published rows by source; the first of equal keys is published."""
    marked = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    per_key = marked.groupBy("source", *key).agg(F.count(F.lit(1)).alias("n"), F.count_if("_valid").alias("ok"))
    return per_key.groupBy("source").agg(F.sum("n").alias("fetched"), F.sum("ok").alias("valid"), F.sum(F.greatest(F.col("ok") - 1, F.lit(0))).alias("duplicate"), F.sum(F.least("ok", F.lit(1))).alias("published"))


def predicted(df: DataFrame, column: str = "weighted_composite_signal") -> DataFrame:
    return df.withColumn("signal_direction", direction(F.col(column)))
