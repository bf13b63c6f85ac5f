"""Numbers that are known beforehand, and one small frame per trap."""

import datetime as dt
import time
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import durations, numbers
from tickloom.functions import text as T
from tickloom.operators import bars as B
from tickloom.operators import features as W
from tickloom.operators import ml as M
from tickloom.operators import parse as P
from tickloom.operators import rules as R
from tickloom.operators import sentiment as S
from tickloom.operators import signals as G
from tickloom.operators import tables as K

T0 = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="A"):
    rows = [(symbol, T0 + dt.timedelta(minutes=k), float(c)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, window_start timestamp, close double")


def last(df, column):
    return df.orderBy(F.col("window_start").desc()).first()[column]


@pytest.mark.parametrize("closes, value", [([100, 101], 50), (range(100, 120), 100), (range(100, 80, -1), 0), ([100] * 20, 50)])
def test_rsi(spark, closes, value):
    assert last(W.rsi(series(spark, closes)), "rsi") == pytest.approx(value)


def test_ema(spark):
    assert W.ema(series(spark, []), 5).count() == 0
    assert last(W.ema(series(spark, [100]), 5), "ema") == 100
    assert last(W.ema(series(spark, [100] * 10 + [200] * 10), 5), "ema") > 150


def test_ema_equals_the_recurrence_at_any_length(spark):
    rng = np.random.default_rng(5)
    for period, n in ((1, 50), (2, 900), (7, 3000), (20, 5000), (300, 2000)):
        closes = rng.normal(100, 20, n)
        want, e = [], closes[0]
        for x in closes:
            e = e * (1 - 2 / (period + 1)) + x * 2 / (period + 1)
            want.append(e)
        df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "k": np.arange(n), "close": closes})).withColumn("window_start", F.timestamp_seconds(F.col("k") * 37))
        got = [r.ema for r in W.ema(df, period).orderBy("window_start").collect()]
        assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_ema_of_a_day_of_seconds_is_quick(spark):
    df = spark.range(86_400).select(F.lit("s").alias("symbol"), F.timestamp_seconds("id").alias("window_start"), (F.col("id") % 97).cast("double").alias("close"))
    W.ema(df.limit(10), 20).count()
    began = time.perf_counter()
    assert W.ema(df, 20).agg(F.count("ema")).first()[0] == 86_400
    assert time.perf_counter() - began < 10


def test_bars_at_equal_bars_of_each_interval(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"), F.col("id").alias("trade_id"), (100 + F.col("id") * 7919 % 101 / 10).alias("price"), (F.col("id") % 5).cast("double").alias("quantity"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("is_buyer_maker"), F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") * 53 / 10) * 3).alias("trade_timestamp"),
    )
    durations = ["5 minutes", "7 minutes", "1 hour", "1 day"]
    got = B.bars_at(rows, durations)
    assert got._jdf.queryExecution().executedPlan().toString().count("Range (") <= 2  # of one plan, and its initial form
    want = [r for d in durations for r in B.bar_features(rows, d).collect()]
    key = lambda r: (r.interval, r.symbol, r.window_start)
    got = sorted(got.collect(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y))), (a, b)


def test_ema_does_not_depend_on_chunks(spark):
    closes = [100 + (k * 37 % 17) for k in range(150)]
    day = {r.window_start: r.ema for r in W.ema(series(spark, closes), 7, chunk="day").collect()}
    hour = {r.window_start: r.ema for r in W.ema(series(spark, closes), 7, chunk="hour").collect()}
    e, want = None, []
    for c in closes:
        e = c if e is None else e * (1 - 0.25) + c * 0.25
        want.append(e)
    for got in (day, hour):
        assert [got[k] for k in sorted(got)] == pytest.approx(want)


def test_bollinger(spark):
    flat = W.bollinger(series(spark, [100] * 20)).orderBy(F.col("window_start").desc()).first()
    assert flat.bb_upper == flat.bb_lower and flat.bb_bandwidth == 0
    r = W.bollinger(series(spark, [100 + k % 5 for k in range(25)])).orderBy(F.col("window_start").desc()).first()
    assert r.bb_upper >= r.bb_middle >= r.bb_lower


@pytest.mark.parametrize("said, value", [("Confidence: 75%", 0.75), ("85% confidence in this BUY", 0.85), ("Strong buy signal", 0.85), ("HOLD recommendation", 0.5), ("confidence 0.7 here", 0.7), ("", 0.5), ("bearish", 0.6)])
def test_confidence(spark, said, value):
    assert spark.range(1).select(R.confidence(F.lit(said)).alias("c")).first().c == pytest.approx(value)


@pytest.mark.parametrize("said, value", [("BUY signal for BTCUSDT", "UP"), ("SELL recommendation", "DOWN"), ("HOLD position", "NEUTRAL"), ("No clear signal", "NEUTRAL"), ("buy or sell", "NEUTRAL")])
def test_stated_direction(spark, said, value):
    assert spark.range(1).select(R.stated_direction(F.lit(said)).alias("d")).first().d == value


def test_rule_classes(spark):
    one = spark.range(1).select(
        R.outlook(F.lit(0.4), F.lit(None).cast("double")).alias("o"), R.risk_level(F.lit(1), F.lit(0.0)).alias("r"), R.risk_level(F.lit(None).cast("int"), F.lit(0.06)).alias("m"), R.trend(F.lit(71.0), F.lit(0.0)).alias("t"),
        S.dominant(F.lit(2), F.lit(2), F.lit(1)).alias("tie"), S.dominant(F.lit(1), F.lit(2), F.lit(2)).alias("neutral"), numbers.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("n"),
    ).first()
    assert tuple(one) == ("BULLISH", "HIGH", "MODERATE", "OVERBOUGHT", "positive", "neutral", None)


def trades(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trade_id long, price double, quantity double, is_buyer_maker boolean, trade_timestamp timestamp")


def test_bars_of_odd_trades(spark):
    rows = [
        ("one", 1, 10.0, 2.0, True, T0),
        ("zero", 2, 10.0, 0.0, False, T0),
        ("tie", 4, 30.0, 1.0, None, T0),
        ("tie", 3, 20.0, 1.0, True, T0),
    ]
    got = {r.symbol: r for r in B.bar_features(trades(spark, rows), "1 minute").collect()}
    assert got["one"].volatility is None and got["one"].buy_sell_ratio == 0 and got["one"].interval == "1m" and got["one"].trade_intensity == pytest.approx(1 / 60)
    assert got["zero"].vwap == 10 and got["zero"].buy_sell_ratio == 0.5
    assert (got["tie"].open, got["tie"].close, got["tie"].buy_volume, got["tie"].sell_volume) == (20, 30, 1, 1)
    flow = {r.symbol: r for r in B.order_flow(trades(spark, rows), "1 minute").collect()}
    assert (flow["tie"].buy_volume, flow["tie"].sell_volume) == (0, 1)
    assert B.bar_features(trades(spark, rows[:0]), "1 minute").collect() == []


def test_rolled_up_bars_are_bars(spark):
    rows = [("s", k, 10.0 + k % 7, 1.0 + k % 3, k % 2 == 0, T0 + dt.timedelta(seconds=20 * k)) for k in range(90)]
    t = trades(spark, rows)
    up = B.rolled_up(B.bar_features(t, "1 minute"), "5 minutes")
    direct = B.bar_features(t, "5 minutes")
    assert up.columns == direct.columns
    same = ["open", "high", "low", "close", "volume", "quote_volume", "buy_volume", "sell_volume", "trade_count", "vwap", "buy_sell_ratio", "price_change_pct", "high_low_range", "trade_intensity"]
    for a, b in zip(up.orderBy("window_start").collect(), direct.orderBy("window_start").collect(), strict=True):
        assert [a[c] for c in same] == pytest.approx([b[c] for c in same])


def test_z_score_takes_21_rows(spark):
    closes = [float(k % 4) for k in range(21)]
    r = series(spark, closes).withColumn("z", W.z_score("close")).orderBy(F.col("window_start").desc()).first()
    mean = sum(closes) / 21
    deviation = (sum((c - mean) ** 2 for c in closes) / 20) ** 0.5
    assert r.z == pytest.approx((closes[-1] - mean) / deviation)
    assert {x.z for x in series(spark, [5] * 4).withColumn("z", W.z_score("close")).collect()} == {0.0}


def test_lags_start_empty_and_order_of_rows_does_not_matter(spark):
    df = series(spark, [1, 2, 4, 8, 16, 32, 64])
    a = df.withColumn("m", W.momentum()).orderBy("window_start").collect()
    b = df.repartition(5).orderBy(F.rand(3)).withColumn("m", W.momentum()).orderBy("window_start").collect()
    assert a == b and [r.m for r in a][:5] == [0.0] * 5 and a[5].m == pytest.approx(3100.0)


def test_silver_trades(spark):
    rows = [
        ("trade", 0, "A", 1, "50000.12345678", "0.00100000", 0, 0, 1700000000000, None, dt.date(2023, 11, 14), T0),
        ("trade", 0, "A", 2, "no number", "1", 0, 0, 1700000000000, True, dt.date(2023, 11, 14), T0),
        ("trade", 0, "B", 1, "1", "1", 0, 0, 1700000000000, True, dt.date(2023, 11, 14), T0),
    ]
    df = spark.createDataFrame(rows, "event_type string, event_time_ms long, symbol string, trade_id long, price string, quantity string, buyer_order_id long, seller_order_id long, trade_time_ms long, is_buyer_maker boolean, trade_date date, ingested_at timestamp")
    got = {r.symbol: r for r in P.silver_trades(df).collect()}
    assert set(got) == {"A", "B"} and got["A"].side == "BUY" and got["B"].side == "SELL"
    assert got["A"].quote_quantity == Decimal("50.0001234567800000") and got["A"].trade_timestamp == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert P.distinct_trades(P.silver_trades(df.unionByName(df))).count() == 2


def test_news_texts(spark):
    df = spark.createDataFrame([("<b> Bitcoin</b> and  eth,\nsol btc unicorn ",)], "t string")
    r = df.select(T.cleaned(F.col("t")).alias("c"), T.collapsed_then_stripped(F.col("t")).alias("s"), T.mentions(F.col("t")).alias("m"), T.word_count(T.cleaned(F.col("t"))).alias("n"), T.mentions(F.lit(None).cast("string")).alias("none")).first()
    assert r.c == "Bitcoin and eth, sol btc unicorn" and r.s == " Bitcoin and eth, sol btc unicorn" and r.m == ["BTC", "ETH", "SOL"] and r.n == 6 and r.none == []
    rows = [("1", "x" * 10, "y" * 51), ("2", "x" * 11, "y" * 51), ("3", "x" * 11, "y" * 50), (None, "x" * 11, "y" * 51)]
    assert [r.article_id for r in P.good_news(spark.createDataFrame(rows, "article_id string, title string, content string")).collect()] == ["2"]


def test_lexicon_sentiment(spark):
    r = spark.range(1).select(T.lexicon_sentiment(F.lit("Rally and surge, no crash")).alias("s"), T.lexicon_sentiment(F.lit("nothing")).alias("n"), T.majority_sentiment(F.lit("bear")).alias("m")).first()
    assert (r.s.label, r.s.confidence, r.n.label, r.n.score, r.n.confidence, r.m) == ("positive", pytest.approx(0.8), "neutral", 0.0, 0.5, "negative")
    assert r.s.score == pytest.approx(1 / 3)


def test_model_scorer_is_loaded_once_and_sees_batches(spark):
    def load():
        return lambda texts: [("positive" if "good" in t else "negative", 0.8) for t in texts]

    df = spark.createDataFrame([("1", "good and long enough"), ("2", "bad and long enough"), ("3", "short"), ("4", None)], "article_id string, content string")
    got = {r.article_id: (r.label, r.score) for r in S.model_scored(df, load).collect()}
    assert got == {"1": ("positive", 0.8), "2": ("negative", -0.8), "3": ("neutral", 0.0), "4": ("neutral", 0.0)}


def test_articles_without_symbol(spark):
    df = spark.createDataFrame([("1", "s", "t", "good", [], T0, 1, "h")], "article_id string, source string, title string, content string, mentioned_symbols array<string>, published_timestamp timestamp, word_count int, content_hash string")
    assert S.scored_articles(df).count() == 0 and S.scored_articles(df, keep_without_symbol=True).first().symbol is None


def test_checked_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, score double")
    good, bad = P.split_checked(df, {"score": F.col("score").between(-1, 1)})
    assert [r.id for r in good.collect()] == [1] and {(r.id, tuple(r.violations)) for r in bad.collect()} == {(2, ("score",)), (3, ("score",))}


def test_tables(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    source = spark.createDataFrame([(2, "B", 1), (3, "C", 2)], "k int, v string, at int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(K.upserted(target, source, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(K.upserted(None, source, ["k"])) == [(2, "B"), (3, "C")]
    assert tuple(K.upsert_counts(target, source, ["k"]).first()) == (1, 1)
    assert rows(K.merged_latest(target, source, ["k"], "at")) == [(1, "a"), (2, "b"), (3, "C")]
    with pytest.raises(ValueError):
        K.upserted(target, source.unionByName(source), ["k"])


def test_versions(spark):
    log = spark.createDataFrame([(1, "a", 1, T0, "upsert"), (2, "b", 1, T0, "upsert"), (1, "A", 2, T0 + dt.timedelta(hours=1), "upsert"), (2, None, 3, T0 + dt.timedelta(hours=2), "delete")], "k int, v string, version long, committed_at timestamp, op string")
    at = lambda **x: sorted((r.k, r.v) for r in K.as_of(log, ["k"], **x).collect())
    assert at(version=1) == [(1, "a"), (2, "b")] and at(version=2) == [(1, "A"), (2, "b")] and at(version=3) == [(1, "A")]
    assert at(timestamp="2024-01-01 01:30:00") == [(1, "A"), (2, "b")] and at(version=0) == []
    assert tuple(K.compared(log, ["k"], 1, 3).first()) == (2, 1, -1, 1, 2, True)
    assert [r.version for r in K.commit_history(log, 2).collect()] == [3, 2]


def test_compaction(spark, tmp_path):
    spark.range(1000).repartition(20).write.parquet(f"{tmp_path}/a")
    assert K.table_details(spark.read.parquet(f"{tmp_path}/a")).first().files == 20
    df = K.compact(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["id"], 2)
    d = K.table_details(df).first()
    assert (d.files, d.rows) == (2, 1000)
    assert K.compact(spark, f"{tmp_path}/a", f"{tmp_path}/c").count() == 1000


def test_book_and_ticker(spark):
    df = spark.createDataFrame([("A", [(100.0, 2.0), (99.0, 1.0)], [(101.0, 1.0)]), ("B", [], [])], "symbol string, bids array<struct<price: double, quantity: double>>, asks array<struct<price: double, quantity: double>>")
    a, b = R.book_metrics(df).orderBy("symbol").collect()
    assert (a.best_bid, a.best_ask, a.spread, a.imbalance) == (100, 101, 1, 0.5) and b.imbalance == 0 and b.spread is None
    d = R.depth_metrics(df).orderBy("symbol").collect()
    assert (d[0].bid_ask_ratio, d[1].spread_pct, d[1].bid_ask_ratio) == (3.0, 0.0, 0.0)


def test_anomaly_types(spark):
    rows = [(True, 4.0, 0.0, 0.0, 0.0), (True, 2.5, 3.5, 0.0, 0.0), (True, 2.5, -3.5, 0.0, 0.0), (True, 0.0, 0.0, 0.95, 0.0), (True, 0.0, 0.0, 0.0, 0.9), (True, 4.5, 2.0, 0.0, 0.0), (True, None, None, None, None), (False, 9.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "f boolean, volume_zscore double, price_change_pct_zscore double, trade_size_uniformity double, buy_sell_imbalance double")
    got = [r.t for r in df.select(R.anomaly_type(F.col("f"))[0].alias("t")).collect()]
    assert got == ["wash_trade", "pump", "dump", "wash_trade", "price_manipulation", "volume_spike", "unknown", None]


def test_durations_and_weights():
    assert durations.seconds("5 minutes") == 300 and durations.short("1 hour") == "1h"
    with pytest.raises(ValueError):
        durations.seconds("3 fortnights")
    with pytest.raises(ValueError):
        G.Weights(0.5, 0.5, 0.5)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [("long", k, 10.0 + (k * 7919) % 101, 1.0 + k % 5, k % 3 == 0, T0 + dt.timedelta(minutes=7 * k)) for k in range(700)] + [("short", 1000 + k, 5.0 + k, 1.0, True, T0 + dt.timedelta(hours=k)) for k in range(5)]
    bars = B.bar_features(trades(spark, rows), "1 minute").unionByName(B.bar_features(trades(spark, [(None, 1, 2.0, 1.0, True, T0)]), "1 minute"))
    no_news = spark.createDataFrame([], "symbol string, window_start timestamp, sentiment_score double, sentiment_confidence double, article_count long")
    found = {
        "time_series": W.time_series, "labelled": lambda df: W.labelled(df, 5), "anomaly": W.anomaly_features, "changes": W.simple_changes, "rsi": W.rsi, "bands": W.bollinger, "z": lambda df: W.normalised(df, ["close"]),
        "fused": lambda df: G.fused(df, no_news), "early": lambda df: M.chronological(df)[0],
    }
    shown = lambda df: sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.collect())
    want = {name: shown(of(bars)) for name, of in found.items()}
    monkeypatch.setattr(W, "BLOCK", 150)
    for name, of in found.items():
        assert shown(of(bars)) == want[name], name
    assert len(want["time_series"]) == 706 and any("None" in x for x in want["time_series"])


def test_early_rows_by_hand(spark):
    early, late = M.chronological(series(spark, range(10)), 0.8)
    assert [r.close for r in early.orderBy("close").collect()] == list(range(8)) and late.count() == 2
    assert [r.fold for r in M.in_folds(series(spark, range(9)), 3).orderBy("close").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
