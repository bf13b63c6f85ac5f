"""Rules that classify rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import clip, ratio

# Anomaly types and their descriptions.
WASH, PUMP, DUMP, MANIPULATION, SPIKE, UNKNOWN = "wash_trade", "pump", "dump", "price_manipulation", "volume_spike", "unknown"


def anomaly_type(is_anomaly: Column) -> tuple[Column, Column]:
    """(type, description) of an anomalous bar by the first rule that holds; NULL for other bars."""
    volume, price = F.coalesce("volume_zscore", F.lit(0.0)), F.coalesce("price_change_pct_zscore", F.lit(0.0))
    rules = [
        ((volume > 3) & (F.abs(price) < 1), WASH, "High volume with minimal price impact"),
        ((price > 3) & (volume > 2), PUMP, "Rapid price increase with high volume"),
        ((price < -3) & (volume > 2), DUMP, "Rapid price decrease with high volume"),
        (F.coalesce("trade_size_uniformity", F.lit(0.0)) > 0.9, WASH, "Suspiciously uniform trade sizes"),
        (F.coalesce("buy_sell_imbalance", F.lit(0.0)) > 0.8, MANIPULATION, "One-sided order flow"),
        (volume > 4, SPIKE, "Unusual volume activity"),
    ]
    kind, said = F.when(~is_anomaly, F.lit(None)), F.when(~is_anomaly, F.lit(None))
    for holds, k, d in rules:
        kind, said = kind.when(holds, k), said.when(holds, d)
    return kind.otherwise(UNKNOWN), said.otherwise("Unclassified anomaly pattern")


# The levels, words and thresholds of the rules below.


def trend(rsi: Column, change: Column) -> Column:
    return F.when(rsi > 70, "OVERBOUGHT").when(rsi < 30, "OVERSOLD").when(change > 0.5, "BULLISH").when(change < -0.5, "BEARISH").otherwise("NEUTRAL")


def outlook(weighted: Column, mean: Column) -> Column:
    score = F.coalesce(weighted, mean, F.lit(0.0))
    return F.when(score > 0.3, "BULLISH").when(score < -0.3, "BEARISH").otherwise("NEUTRAL")


def risk_level(anomalies: Column, volatility: Column) -> Column:
    return F.when(F.coalesce(anomalies, F.lit(0)) > 0, "HIGH").when(F.coalesce(volatility, F.lit(0.0)) > 0.05, "MODERATE").otherwise("LOW")


def position_advice(level: Column) -> Column:
    return F.when(level == "HIGH", "Reduce position size").otherwise("Standard position")


def confidence(text: Column) -> Column:
    """Confidence stated in a text: a percentage, a decimal, or what its words suggest."""
    t = F.coalesce(text, F.lit(""))
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("double")
    percent = F.coalesce(number(r"[Cc]onfidence[:\s]+(\d{1,3})%"), number(r"(\d{1,3})%\s*[Cc]onfidence"))
    low = F.lower(t)
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))
    words = F.when(has("strong buy", "highly confident", "very bullish"), 0.85).when(has("buy", "bullish", "confident"), 0.7).when(has("hold", "neutral", "wait"), 0.5).when(has("sell", "bearish"), 0.6).otherwise(0.5)
    return F.coalesce(F.when(percent > 1, percent / 100).otherwise(percent), number(r"[Cc]onfidence[:\s]+(0\.\d{1,2})"), words)


def stated_direction(text: Column) -> Column:
    up, down = F.contains(F.upper(text), F.lit("BUY")), F.contains(F.upper(text), F.lit("SELL"))
    return F.when(up & ~down, "UP").when(down & ~up, "DOWN").otherwise("NEUTRAL")


def ticker_features(tickers: DataFrame) -> DataFrame:
    """Features out of a day's ticker, rounded as they are served."""
    num = lambda c: F.col(c).try_cast("double")
    price, high, low, volume, quote, change = (num(c) for c in ("lastPrice", "highPrice", "lowPrice", "volume", "quoteVolume", "priceChangePercent"))
    strength = F.when(change > 5, 75 + F.least(change, F.lit(25.0))).when(change > -5, 50 + change * 5).otherwise(F.greatest(25 + change, F.lit(0.0)))
    return tickers.select(
        "symbol", price.alias("close"), num("openPrice").alias("open"), high.alias("high"), low.alias("low"), volume.alias("volume"), quote.alias("quote_volume"), F.col("count").alias("trade_count"),
        F.round(ratio(quote, volume, price), 2).alias("vwap"), F.round(ratio(high - low, price), 6).alias("volatility"), F.round(strength, 1).alias("rsi"), F.round(price * 0.98, 2).alias("ema_20"),
        F.round(clip(0.5 + change / 20, 0.1, 0.9), 4).alias("buy_sell_ratio"), F.round(change, 2).alias("price_change_pct"), F.round(ratio((high - low) * 100, low), 4).alias("high_low_range"),
        F.round(F.col("count") / 86400, 2).alias("trade_intensity"),
    )


def ticker_view(tickers: DataFrame) -> DataFrame:
    names = {"price": "lastPrice", "change": "priceChangePercent", "high": "highPrice", "low": "lowPrice", "volume": "volume", "quote_volume": "quoteVolume"}
    return tickers.select("symbol", *[F.col(c).try_cast("double").alias(n) for n, c in names.items()], F.col("count").alias("trades"))


def book_metrics(books: DataFrame) -> DataFrame:
    """Best prices, spread, volumes and imbalance of order books (best level first); NULLs without a side."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["quantity"])
    bid, ask, bids, asks = F.get("bids", 0)["price"], F.get("asks", 0)["price"], total("bids"), total("asks")
    return books.withColumns({"best_bid": bid, "best_ask": ask, "spread": ask - bid, "spread_pct": F.try_divide((ask - bid) * 100, bid), "bid_volume": bids, "ask_volume": asks, "imbalance": ratio(bids - asks, bids + asks)})


def depth_metrics(books: DataFrame, levels: int = 5) -> DataFrame:
    """Rounded metrics of the first levels; a missing side counts as 0."""
    total = lambda c: F.aggregate(F.slice(c, 1, levels), F.lit(0.0), lambda a, x: a + x["quantity"])
    bid, ask = (F.coalesce(F.get(c, 0)["price"], F.lit(0.0)) for c in ("bids", "asks"))
    return books.select(
        "symbol", bid.alias("best_bid"), ask.alias("best_ask"), F.round(ask - bid, 2).alias("spread"), F.round(ratio((ask - bid) * 100, bid), 6).alias("spread_pct"), total("bids").alias("bid_depth"), total("asks").alias("ask_depth"),
        F.round(total("bids") / F.greatest(total("asks"), F.lit(0.001)), 4).alias("bid_ask_ratio"),
    )
