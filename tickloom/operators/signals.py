"""Signals of bars with sentiment, and their weighted fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import direction, ratio
from tickloom.operators.features import in_blocks, momentum, rows, series, vwap_deviation, z_score
from tickloom.operators.sentiment import with_sentiment
from tickloom.sources.files import read_table, write_table


@dataclass(frozen=True)
class Weights:
    market: float = 0.5
    sentiment: float = 0.3
    timeseries: float = 0.2

    def __post_init__(self) -> None:
        if abs(self.market + self.sentiment + self.timeseries - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


def market_signal(bars: DataFrame, back: int = 20) -> DataFrame:
    out = bars.withColumn("vwap_deviation", vwap_deviation())
    out = out.withColumns({f"{c}_normalised": z_score(c, back) for c in ("price_change_pct", "vwap_deviation", "buy_sell_ratio")})
    return out.withColumn("market_signal", 0.4 * F.col("price_change_pct_normalised") + 0.3 * F.col("vwap_deviation_normalised") + 0.3 * F.col("buy_sell_ratio_normalised"))


def sentiment_momentum(first_counts: bool = False):
    """Change of the score; at the start 0, or the score itself if a missing one counts as 0."""
    before = F.lag("sentiment_score").over(series())
    return F.col("sentiment_score") - F.coalesce(before, F.lit(0.0) if first_counts else F.col("sentiment_score"))


def sentiment_signal(bars: DataFrame, decay: float = 0.9, back: int = 20) -> DataFrame:
    """Score times confidence where there are articles, else what is left of the previous score."""
    stale = F.lag("sentiment_score").over(series()) * decay
    out = bars.withColumns({"sentiment_momentum": sentiment_momentum(True), "sentiment_signal": F.when(F.col("article_count") > 0, F.col("sentiment_score") * F.col("sentiment_confidence")).otherwise(stale)})
    return out.withColumn("sentiment_signal_normalised", z_score("sentiment_signal", back))


def timeseries_signal(bars: DataFrame, back: int = 20) -> DataFrame:
    short, long, before = F.avg("close").over(rows(4)), F.avg("close").over(rows(19)), F.lag("volatility").over(series())
    out = bars.withColumns({"ema_crossover": ratio((short - long) * 100, long), "price_momentum": momentum(), "volatility_trend": ratio(F.col("volatility") - before, before)})
    out = out.withColumns({f"{c}_normalised": z_score(c, back) for c in ("ema_crossover", "price_momentum")})
    return out.withColumn("timeseries_signal", 0.5 * F.col("ema_crossover_normalised") + 0.3 * F.col("price_momentum_normalised") + 0.2 * F.col("volatility_trend"))


def composite(df: DataFrame, weights: Weights = Weights(), threshold: float = 0.1) -> DataFrame:
    value = weights.market * F.col("market_signal") + weights.sentiment * F.col("sentiment_signal_normalised") + weights.timeseries * F.col("timeseries_signal")
    out = df.withColumn("weighted_composite_signal", value)
    return out.withColumns({"signal_strength": F.abs("weighted_composite_signal"), "signal_direction": direction(F.col("weighted_composite_signal"), threshold)}).na.fill(0.0)


def simple_composite(df: DataFrame, weights: Weights = Weights()) -> DataFrame:
    return df.withColumn("weighted_composite_signal", weights.market * F.col("price_change_pct") + weights.sentiment * F.col("sentiment_score") + weights.timeseries * F.col("momentum"))


def fused(bars: DataFrame, sentiment: DataFrame, weights: Weights = Weights(), back: int = 20) -> DataFrame:
    """Join, three signals, composite: one shuffle by blocks of a symbol serves all windows. The longest reach is the
    z-score's over `back` crossovers, which look at 19 more closes."""
    signals = lambda b: timeseries_signal(sentiment_signal(market_signal(b, back), back=back), back)
    return composite(in_blocks(with_sentiment(bars, sentiment), signals, back=back + 20), weights)


def saved(fused_signals: DataFrame, path: str) -> None:
    """Writes signals by day and symbol; a day that is written again is replaced."""
    write_table(fused_signals.withColumn("signal_date", F.to_date("window_start")), path, ["signal_date", "symbol"], "overwrite")


def run(bars: DataFrame, sentiment: DataFrame, path: str, weights: Weights = Weights()) -> DataFrame:
    """Fuses, saves, and gives the saved table."""
    saved(fused(bars, sentiment, weights), path)
    return read_table(bars.sparkSession, path)


def momenta(bars: DataFrame) -> DataFrame:
    """Both momenta of the sentiment score: from the series' start on, and with a missing score as 0."""
    return in_blocks(bars, lambda b: b.withColumns({"from_start": sentiment_momentum(), "from_zero": sentiment_momentum(True)}), back=1)
