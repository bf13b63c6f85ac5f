"""Tumbling-window bars over trades, and roll-ups of bars.

Open and close follow (timestamp, trade id), so ties have an order. On a stream a watermark is set; on
a batch frame it has no effect.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.durations import seconds, short
from tickloom.functions.numbers import change_pct, ratio

TIME = "trade_timestamp"


def windowed(trades: DataFrame, duration: str, watermark: str | None):
    if watermark and trades.isStreaming:
        trades = trades.withWatermark(TIME, watermark)
    return trades.groupBy("symbol", F.window(TIME, duration).alias("w"))


def bounds() -> list[Column]:
    return [F.col("symbol"), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]


def edges() -> dict[str, Column]:
    return {"window_start": F.col("w.start"), "window_end": F.col("w.end")}


def opening() -> Column:
    return F.min_by("price", F.struct(TIME, "trade_id"))


def closing() -> Column:
    return F.max_by("price", F.struct(TIME, "trade_id"))


def ohlc(trades: DataFrame, duration: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    made = windowed(trades, duration, watermark).agg(
        opening().alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), closing().alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return made.select(*bounds(), "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def vwap(trades: DataFrame, duration: str = "5 minutes", watermark: str = "30 seconds") -> DataFrame:
    """Volume-weighted price; NULL without volume."""
    made = windowed(trades, duration, watermark).agg(F.sum(F.col("price") * F.col("quantity")).alias("pq"), F.sum("quantity").alias("volume"))
    return made.select(*bounds(), ratio(F.col("pq"), F.col("volume"), None).alias("vwap"), "volume")


def volatility(trades: DataFrame, duration: str = "5 minutes", watermark: str = "30 seconds") -> DataFrame:
    """Relative deviation of prices in percent, and the deviation of their logarithms; NULL for one trade.

    A price of zero or less has no logarithm (NULL): it counts in volatility and sample_count, but not in log_price_stddev."""
    log_price = F.log(F.when(F.col("price") > 0, F.col("price")))
    made = windowed(trades, duration, watermark).agg(F.avg("price").alias("mean"), F.stddev("price").alias("deviation"), F.stddev(log_price).alias("log_price_stddev"), F.count(F.lit(1)).alias("sample_count"))
    return made.select(*bounds(), ratio(F.col("deviation") * 100, F.col("mean"), None).alias("volatility"), "log_price_stddev", "sample_count")


def order_flow(trades: DataFrame, duration: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    """Volume by aggressor; trades of unknown side count for neither."""
    made = windowed(trades, duration, watermark).agg(
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(F.lit(0.0))).alias("buy_volume"), F.sum(F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(F.lit(0.0))).alias("sell_volume"),
    )
    return made.select(*bounds(), "buy_volume", "sell_volume", ratio(F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume"), 0.5).alias("buy_sell_ratio"))


BAR = [
    "symbol", "interval", "window_start", "window_end", "open", "high", "low", "close", "volume", "quote_volume", "buy_volume", "sell_volume", "trade_count", "vwap", "volatility",
    "buy_sell_ratio", "price_change", "price_change_pct", "high_low_range", "trade_intensity",
]


def finished(made: DataFrame, duration: str) -> DataFrame:
    return derived(made, F.lit(short(duration)), F.lit(seconds(duration)))


def derived(made: DataFrame, interval: Column, length: Column) -> DataFrame:
    """Derived columns of a bar out of its sums; `length` in seconds."""
    return made.withColumns(
        {
            "interval": interval,
            "buy_sell_ratio": ratio(F.col("buy_volume"), F.col("volume"), 0.5),
            "price_change": F.col("close") - F.col("open"),
            "price_change_pct": change_pct(F.col("close"), F.col("open")),
            "high_low_range": change_pct(F.col("high"), F.col("low")),
            "trade_intensity": F.col("trade_count") / length,
        }
    ).select(*BAR)


def bar_features(trades: DataFrame, duration: str = "1 minute", watermark: str = "10 seconds") -> DataFrame:
    """Bars with 20 columns. A bar of one trade has no volatility (NULL); without volume vwap is the close
    and the ratio one half; a trade of unknown side is a buy."""
    sell = F.coalesce(F.col("is_buyer_maker"), F.lit(False))
    made = windowed(trades, duration, watermark).agg(
        opening().alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), closing().alias("close"), F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"), F.sum(F.when(~sell, F.col("quantity")).otherwise(F.lit(0.0))).alias("buy_volume"),
        F.sum(F.when(sell, F.col("quantity")).otherwise(F.lit(0.0))).alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"), F.avg("price").alias("mean"), F.stddev("price").alias("deviation"),
    )
    made = made.withColumns(edges()).drop("w").withColumns({"vwap": ratio(F.col("quote_volume"), F.col("volume"), F.col("close")), "volatility": F.when(F.col("mean") > 0, F.try_divide(F.col("deviation") * 100, F.col("mean"))).otherwise(F.lit(0.0))})
    return finished(made, duration)


def rolled_up(bars: DataFrame, duration: str) -> DataFrame:
    """Bars of a longer interval out of shorter ones, with all of a bar's columns; volatility is the mean."""
    first, last = (lambda c: F.min_by(c, "window_start")), (lambda c: F.max_by(c, "window_start"))
    made = bars.groupBy("symbol", F.window("window_start", duration).alias("w")).agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "buy_volume", "sell_volume", "trade_count")],
        F.sum(F.col("vwap") * F.col("volume")).alias("weighted"), F.avg("volatility").alias("volatility"),
    )
    made = made.withColumns(edges()).drop("w").withColumn("vwap", ratio(F.col("weighted"), F.col("volume"), F.col("close")))
    return finished(made, duration)


def bar_states(trades: DataFrame, duration: str) -> DataFrame:
    """What bars are made of, a row a symbol and window, in a form that merges: first and last trade, extremes, sums, and the
    squared deviation of prices from their own mean."""
    sell = F.coalesce(F.col("is_buyer_maker"), F.lit(False))
    part = lambda kind: F.sum(F.when(kind, F.col("quantity")).otherwise(F.lit(0.0)))
    trade = F.struct(TIME, "trade_id", "price")
    return trades.groupBy("symbol", F.window(TIME, duration).alias("w")).agg(
        F.min(trade).alias("first"), F.max(trade).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"),
        part(~sell).alias("buy_volume"), part(sell).alias("sell_volume"), F.count(F.lit(1)).alias("trade_count"), F.count("price").alias("n"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count("price")).alias("squares"),
    ).withColumn("start", F.col("w.start")).drop("w")


def bars_at(trades: DataFrame, durations: list[str]) -> DataFrame:
    """Bars at several intervals, in one table, from one scan and one shuffle of the trades.

    States of the longest interval that divides all of them are made first; each state goes to its window of every interval,
    where states merge: bars are the same as `bar_features` gives, volatility included, up to rounding. A stream has an
    aggregate an interval."""
    if trades.isStreaming:  # windows close one by one: an aggregate an interval
        return reduce(DataFrame.unionByName, [bar_features(trades, d) for d in durations])
    lengths = [seconds(d) for d in durations]
    states = bar_states(trades, f"{math.gcd(*lengths)} seconds")
    begin = lambda n: F.timestamp_seconds(F.floor(F.unix_timestamp("start") / n) * n)
    targets = F.array(*[F.struct(F.lit(short(d)).alias("interval"), F.lit(n).alias("length"), begin(n).alias("at")) for d, n in zip(durations, lengths, strict=True)])
    dealt = states.withColumn("t", F.explode(targets)).select("*", "t.*").drop("t")
    own = Window.partitionBy("symbol", "interval", "length", "at")
    centred = dealt.withColumn("centre", F.try_divide(F.sum(F.col("mean") * F.col("n")).over(own), F.sum("n").over(own)))
    made = centred.groupBy("symbol", "interval", "length", "at").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "buy_volume", "sell_volume", "trade_count", "n")],
        F.max("centre").alias("mean"), F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))).alias("squares"),
    )
    deviation = F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1))
    out = made.withColumns({"open": F.col("first.price"), "close": F.col("last.price"), "window_start": F.col("at"), "window_end": F.timestamp_seconds(F.unix_timestamp("at") + F.col("length"))})
    out = out.withColumns({"vwap": ratio(F.col("quote_volume"), F.col("volume"), F.col("close")), "volatility": F.when(F.col("mean") > 0, F.try_divide(deviation * 100, F.col("mean"))).otherwise(F.lit(0.0))})
    return derived(out, F.col("interval"), F.col("length"))


def body_pct(open_: Column, close: Column) -> Column:
    return F.when(open_ == 0, F.lit(0.0)).otherwise(F.try_divide((close - open_) * 100, open_))
