"""Registered queries. Each takes the session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import text as T
from tickloom.operators import bars as B
from tickloom.operators import features as W
from tickloom.operators import ml as M
from tickloom.operators import parse as P
from tickloom.operators import rules as R
from tickloom.operators import sentiment as S
from tickloom.operators import serve as O
from tickloom.operators import signals as G
from tickloom.operators import stored
from tickloom.operators import tables as K
from tickloom.sources import adapters as A
from tickloom.session import scratch_path
from tickloom.sources import feeds, files
from tickloom.streaming import pipelines as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOUR, DAY_PART = "1 hour", "4 hours"
SYMBOLS, NAMES = ("THAT", "WITH", "THIS", "FROM"), {"WERE": "THIS"}
LEXICON = T.Lexicon(("thing", "with", "from"), ("tion", "this"))


def shown(df: DataFrame) -> DataFrame:
    """Numbers rounded to 6 digits, times and lists as text, so that engines can be compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array<string>":
            c = F.concat_ws(",", c)
        out.append(c.alias(name))
    return df.select(*out)


def query(*columns: str):
    """Registers a function under its name; its result shows the named columns, or all."""

    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return shown(df.select(*columns) if columns else df)

        QUERIES[f.__name__] = run
        return run

    return register


def events(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return A.trades(events(spark, d))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.bar_features(trades(spark, d), HOUR)


def silver_news(spark: SparkSession, d: str) -> DataFrame:
    return P.silver_news(A.news(A.table(spark, d, "documents")), SYMBOLS, NAMES)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.scored_articles(silver_news(spark, d), lexicon=LEXICON)


def bar_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment by hour and symbol; documents are dealt to symbols by their id."""
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "error")])
    s = T.lexicon_sentiment(F.col("text"), T.Lexicon(("thing", "with"), ("tion", "this")))
    at = F.date_trunc("hour", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    docs = A.table(spark, d, "documents").select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("symbol"), at.alias("window_start"), s.alias("s"))
    return S.mean_sentiment(docs.select("symbol", "window_start", F.col("s.score").alias("sentiment_score"), F.col("s.confidence").alias("sentiment_confidence")))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return G.fused(bars(spark, d), bar_sentiment(spark, d))


def bronze(spark: SparkSession, d: str) -> DataFrame:
    return P.bronze_trades(A.raw_trades(events(spark, d)))


# --- aggregations -----------------------------------------------------------------------------------


@query()
def a1_ohlc(spark, d):
    return B.ohlc(trades(spark, d), HOUR)


@query()
def a2_vwap(spark, d):
    return B.vwap(trades(spark, d), HOUR)


@query()
def a3_volatility(spark, d):
    return B.volatility(trades(spark, d), HOUR)


@query()
def a4_order_flow(spark, d):
    return B.order_flow(trades(spark, d), HOUR)


@query()
def a5_bar_features(spark, d):
    return bars(spark, d)


@query()
def a6_rolled_up(spark, d):
    return B.rolled_up(bars(spark, d), DAY_PART)


@query()
def a7_sentiment_windows(spark, d):
    return S.sentiment_windows(scored(spark, d))


@query()
def a8_mean_sentiment(spark, d):
    return bar_sentiment(spark, d)


@query()
def a9_profile(spark, d):
    return W.profile(bars(spark, d), ["volume", "trade_count", "price_change_pct", "high_low_range", "buy_sell_ratio"])


@query()
def a11_ingestion_summary(spark, d):
    return O.ingestion_summary(events(spark, d).withColumn("source", F.col("event_type")), F.col("value") > 50, ["user_id"])


@query()
def a12_market_stats(spark, d):
    return O.market_stats(O.latest(bars(spark, d), ["symbol"]))


@query()
def a13_label_counts(spark, d):
    return S.label_counts(silver_news(spark, d).select(T.majority_sentiment(F.col("content"), LEXICON).alias("sentiment")))


@query()
def a14_market_overview(spark, d):
    found = events(spark, d).filter("value > 400").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("detected_at"))
    return O.market_overview(bars(spark, d), fused(spark, d), found, "2024-01-10", "2024-01-20")


# --- windows ----------------------------------------------------------------------------------------


def with_repeats(df: DataFrame, price) -> DataFrame:
    """Every tenth trade again, later and one dearer."""
    first = df.withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp"))
    again = first.filter("trade_id % 10 = 0").withColumns({"price": price(F.col("price")), "ingested_at": F.lit("2024-02-02").cast("timestamp")})
    return first.unionByName(again)


@query("symbol", "trade_id", "price")
def w1_distinct_trades(spark, d):
    return P.distinct_trades(with_repeats(trades(spark, d), lambda p: p + 1))


@query("content_hash", "article_id")
def w2_distinct_news(spark, d):
    return P.distinct_news(silver_news(spark, d))


@query("symbol", "window_start", "price_change_pct_lag_1", "price_change_pct_lag_3", "price_change_pct_lag_5", "volume_change_pct", "volatility_change", "ema_short", "ema_long", "ema_crossover", "rolling_mean_price", "rolling_std_price", "momentum", "vwap_deviation", "volatility")
def w3_w11_time_series(spark, d):
    return W.time_series(bars(spark, d))


@query("symbol", "window_start", "direction")
def w12_labels(spark, d):
    return W.labelled(bars(spark, d))


@query("symbol", "window_start", "from_start", "from_zero")
def w13_sentiment_momentum(spark, d):
    return G.momenta(S.with_sentiment(bars(spark, d), bar_sentiment(spark, d)))


@query("symbol", "window_start", "close_normalised", "volume_normalised")
def w14_z_score(spark, d):
    return W.normalised(bars(spark, d), ["close", "volume"])


@query("symbol", "window_start", "vwap_deviation", "price_change_pct_lag1", "price_change_pct_lag2", "price_change_pct_lag3", "volume_change_pct", "volatility_change")
def w17_simple_changes(spark, d):
    return W.simple_changes(bars(spark, d))


@query("symbol", "window_start", *M.ANOMALY)
def w18_w21_anomaly_features(spark, d):
    return W.anomaly_features(bars(spark, d))


@query("symbol", "window_start", "rsi")
def w22_rsi(spark, d):
    return W.rsi(bars(spark, d))


@query()
def w23_ema(spark, d):
    return W.ema(bars(spark, d), 20)


@query("symbol", "window_start", "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth")
def w24_bollinger(spark, d):
    return W.bollinger(bars(spark, d))


# --- signals and rules ------------------------------------------------------------------------------


@query("symbol", "window_start", "market_signal", "sentiment_momentum", "sentiment_signal", "sentiment_signal_normalised", "timeseries_signal", "weighted_composite_signal", "signal_strength", "signal_direction")
def g1_g4_fusion(spark, d):
    return fused(spark, d)


@query("symbol", "window_start", "weighted_composite_signal")
def g5_simple_composite(spark, d):
    return G.simple_composite(S.with_sentiment(W.time_series(bars(spark, d)), bar_sentiment(spark, d)))


@query("user_id", "label")
def c1_dominant_label(spark, d):
    v = F.col("value")
    per = events(spark, d).groupBy("user_id").agg(F.count_if(v > 300).alias("p"), F.count_if(v < 100).alias("n"), F.count_if((v >= 100) & (v <= 300)).alias("u"))
    return per.withColumn("label", S.dominant(F.col("p"), F.col("n"), F.col("u")))


@query("symbol", "window_start", "anomaly_type")
def c2_anomaly_type(spark, d):
    return W.anomaly_features(bars(spark, d)).withColumn("anomaly_type", R.anomaly_type(F.col("volume") > 20)[0])


@query("symbol", "window_start", "trend", "outlook", "risk", "advice")
def c3_c5_trend_and_risk(spark, d):
    risk = R.risk_level(F.when(F.col("trade_count") > 8, 1), F.col("volatility"))
    rows = W.rsi(G.simple_composite(S.with_sentiment(W.time_series(bars(spark, d)), bar_sentiment(spark, d))), 2)
    weighted = F.when(F.col("trade_count") % 3 > 0, F.round("weighted_composite_signal", 6) / 100)
    return rows.withColumns({"trend": R.trend(F.round("rsi", 6), F.col("price_change_pct")), "outlook": R.outlook(weighted, F.col("buy_sell_ratio") - 0.5), "risk": risk, "advice": R.position_advice(risk)})


@query()
def c6_c7_stated(spark, d):
    said = F.concat(F.when(F.col("turn") % 3 == 0, "Buy ").when(F.col("turn") % 3 == 1, "sell ").otherwise(""), F.coalesce("text", F.lit("")))
    n = (F.col("turn") * 7 % 100).cast("string")
    percent = F.concat(F.lit("Confidence: "), n, F.lit("%"))
    forms = [percent, F.concat(n, F.lit("%  confidence")), F.concat(F.lit("confidence 0."), n), F.lit("a STRONG buy"), F.lit("buy or hold"), F.lit("wait, do not sell"), F.lit("bearish"), F.lit("no word of it"), F.coalesce("text", F.lit(""))]
    form = F.get(F.array(*forms), ((F.col("conv_id") + F.col("turn")) % len(forms)).cast("int"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", R.stated_direction(said).alias("direction"), R.confidence(percent).alias("confidence"), R.confidence(form).alias("worded"))


# --- serving ----------------------------------------------------------------------------------------


@query("symbol", "interval", "trade_count", "close", "volume", "vwap", "window_start")
def o1_latest(spark, d):
    return O.latest(bars(spark, d), ["symbol", "interval"])


@query("symbol", "interval", "close", "volume", "window_start")
def o2_history(spark, d):
    return O.history(bars(spark, d), "click", "1h", 60)


@query()
def o3_alerts(spark, d):
    found = events(spark, d).select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("detected_at"), (F.col("value") / 500).alias("severity"))
    return O.alerts(found, "view", "2024-01-05", "2024-01-25", 0.5, 100)


@query("event_id", "symbol")
def o4_of_symbols(spark, d):
    return O.of_symbols(events(spark, d).withColumn("symbol", F.col("event_type")), " click, view ,")


@query()
def o6_newest_articles(spark, d):
    news = A.news(A.table(spark, d, "documents"))
    return O.newest_articles(news.withColumn("published_at", F.col("published_at").cast("timestamp")))


# --- unions and joins -------------------------------------------------------------------------------


@query("content_hash", "article_id")
def u1_first_seen_news(spark, d):
    news = silver_news(spark, d)
    own = F.col("source").eqNullSafe("src0")
    return P.first_seen_news([news.filter(own), news.filter(~own)])


@query()
def u2_bars_at(spark, d):
    return B.bars_at(trades(spark, d), [HOUR, DAY_PART, "1 day"])


@query("symbol", "window_start", "close", "sentiment_score", "sentiment_confidence", "article_count")
def j1_with_sentiment(spark, d):
    return S.with_sentiment(bars(spark, d), bar_sentiment(spark, d))


# --- parsing and filters ----------------------------------------------------------------------------


@query("trade_id", "symbol", "price", "quantity", "quote_quantity", "side", "trade_timestamp")
def p3_p5_silver_trades(spark, d):
    return P.silver_trades(bronze(spark, d))


@query("article_id", "source", "title", "mentioned_symbols", "word_count", "content_hash", "published_timestamp")
def p6_p10_silver_news(spark, d):
    return silver_news(spark, d)


@query()
def p7_stripped_pages(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.collapsed_then_stripped(F.col("html")).alias("content"))


@query("event_id", "ts")
def p11_within_dates(spark, d):
    rows = events(spark, d).withColumns({"ts": F.col("ts").cast("timestamp"), "trade_date": F.to_date("ts")})
    return P.within_dates(rows, "trade_date", "2024-01-05", "2024-01-10")


@query("symbol", "window_start")
def p12_interval(spark, d):
    return B.bars_at(trades(spark, d), [HOUR, DAY_PART]).filter("interval = '1h'")


@query("article_id")
def p18_published_since(spark, d):
    news = A.news(A.table(spark, d, "documents"))
    return feeds.published_since(news.withColumn("published_at", F.col("published_at").cast("timestamp")), F.lit("2024-01-01 05:00:00").cast("timestamp"), "5 minutes")


@query()
def p19_content_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.content_hash(F.substring("text", 1, 80), F.col("text")).alias("content_hash"))


@query("event_id", "violations")
def p20_checked(spark, d):
    return P.checked(events(spark, d), {"value": F.col("value") <= 400, "user": F.col("user_id") >= 10})


def books(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a book: odd ones bid, even ones ask."""
    level = lambda odd: F.when(F.col("l_linenumber") % 2 == odd, F.struct(F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity")))
    return A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("symbol")).agg(F.sort_array(F.collect_list(level(0)), False).alias("bids"), F.sort_array(F.collect_list(level(1))).alias("asks"))


@query("symbol", "best_bid", "best_ask", "bid_volume", "ask_volume", "imbalance")
def p21_book(spark, d):
    return R.book_metrics(books(spark, d))


@query()
def p22_depth(spark, d):
    return R.depth_metrics(books(spark, d), 2)


def tickers(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    price, change = F.col("o_totalprice").cast("double"), (F.col("o_orderkey") % 41).cast("double") / 2 - 10
    return A.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("symbol"), text(price).alias("lastPrice"), text(price * 1.1).alias("highPrice"), text(price * 0.9).alias("lowPrice"), text(price).alias("openPrice"), text(F.col("o_orderkey") % 7).alias("volume"),
        text(price * (F.col("o_orderkey") % 7)).alias("quoteVolume"), F.col("o_custkey").alias("count"), text(change).alias("priceChangePercent"),
    )


@query("symbol", "trade_count", "close", "vwap", "volatility", "rsi", "buy_sell_ratio", "price_change_pct")
def p23_ticker_features(spark, d):
    return R.ticker_features(tickers(spark, d))


@query("symbol", "price", "change", "trades")
def p24_ticker_view(spark, d):
    return R.ticker_view(tickers(spark, d))


@query("doc_id")
def p25_from_source(spark, d):
    return P.from_source(A.table(spark, d, "documents"), "RC1")


@query("symbol", "window_start", "body_pct")
def p26_body_pct(spark, d):
    return bars(spark, d).withColumn("body_pct", B.body_pct(F.col("open"), F.col("close")))


# --- sources, functions, tables ---------------------------------------------------------------------


@query("event_id", "value")
def s5_read_table(spark, d):
    return files.read_table(spark, f"{d}/events.parquet", "value > 100 AND event_type = 'click'")


@query()
def s8_messages(spark, d):
    sent = files.messages(events(spark, d), F.col("event_type"), {"v": "1"})
    return sent.select(F.col("key").cast("string").alias("key"), F.get_json_object(F.col("value").cast("string"), "$.event_id").cast("long").alias("event_id"))


@query()
def ud2_lexicon(spark, d):
    s = T.lexicon_sentiment(F.concat_ws(" ", "title", "content"), LEXICON)
    return silver_news(spark, d).select("article_id", s.alias("s")).select("article_id", "s.label", "s.score", "s.confidence")


@query()
def ud4_majority(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.majority_sentiment(F.col("text"), LEXICON).alias("sentiment"))


@query("article_id", "symbol", "sentiment_label", "sentiment_score", "sentiment_confidence")
def ud5_scored_articles(spark, d):
    return scored(spark, d)


def target_and_source(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All events, and all of them again, dearer and with doubled ids: some known, some new."""
    e = events(spark, d)
    return e.select("event_id", "value", F.lit(0).alias("at")), e.select((F.col("event_id") * 2).alias("event_id"), (F.col("value") + 100).alias("value"), (F.col("user_id") % 2).cast("int").alias("at"))


@query("event_id", "value")
def t1_upserted(spark, d):
    return K.upserted(*target_and_source(spark, d), ["event_id"])


@query()
def t1_upsert_counts(spark, d):
    return K.upsert_counts(*target_and_source(spark, d), ["event_id"])


@query("event_id", "value")
def t2_merged_latest(spark, d):
    return K.merged_latest(*target_and_source(spark, d), ["event_id"], "at")


def change_log(spark: SparkSession, d: str) -> DataFrame:
    version = F.floor(F.col("event_id") / 500).cast("long")
    return events(spark, d).select((F.col("event_id") % 500).alias("k"), F.col("value").alias("v"), version.alias("version"), F.timestamp_seconds(F.lit(1704067200) + version * 60).alias("committed_at"), F.when(F.col("user_id") % 10 == 0, "delete").otherwise("upsert").alias("op"))


@query()
def t3_at_version(spark, d):
    return K.as_of(change_log(spark, d), ["k"], version=10)


@query()
def t4_at_timestamp(spark, d):
    return K.as_of(change_log(spark, d), ["k"], timestamp="2024-01-01 00:05:00")


@query()
def t5_compared(spark, d):
    return K.compared(change_log(spark, d), ["k"], 5, 10)


@query()
def t6_commit_history(spark, d):
    return K.commit_history(change_log(spark, d))


@query("symbol", "trade_id", "price")
def t8_reprocessed(spark, d):
    first = bronze(spark, d).withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp"))
    again = first.filter("trade_id % 10 = 0").withColumns({"price": (F.col("price").cast("decimal(18,8)") + 1).cast("string"), "ingested_at": F.lit("2024-02-02").cast("timestamp")})
    return K.reprocessed(P.silver_trades(first), again)


@query()
def t7_compacted(spark, d):
    """All events in many files, then in few, sorted by id."""
    many, few = scratch_path(spark, "many"), scratch_path(spark, "few")
    events(spark, d).select("event_id", "event_type", "value").repartition(16).write.parquet(many)
    return K.compact(spark, many, few, ["event_id"], 2)


# --- feeds, files and streams -----------------------------------------------------------------------


@query("article_id", "source", "title", "n_chars", "published_at", "publish_date", "kafka_key")
def p2_bronze_news(spark, d):
    """Articles as broker messages, parsed again."""
    news = A.news(A.table(spark, d, "documents"))
    at = F.lit("2024-01-01").cast("timestamp")
    sent = news.select(F.col("source").cast("binary").alias("key"), F.to_json(F.struct(*news.columns)).cast("binary").alias("value"), F.lit("news").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), at.alias("timestamp"))
    return P.bronze_news(sent).withColumns({"n_chars": F.length("content").cast("long"), "publish_date": F.col("publish_date").cast("string")})


def trade_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Wire records of every event, bare or in the stream's envelope, each with a message of another kind and a broken one."""
    value = F.col("value").cast("string")
    sent = F.when(F.col("offset") % 2 == 1, F.concat(F.lit('{"stream": "x@trade", "data": '), value, F.lit("}"))).otherwise(value)
    return A.raw_trades(events(spark, d)).select(F.explode(F.array(sent, F.regexp_replace(value, '"e":"trade"', '"e":"depth"'), F.substring(value, 1, 20))).alias("value"))


@query("trade_id", "symbol", "price", "quantity", "is_buyer_maker", "event_time_ms")
def p13_stream_trades(spark, d):
    return feeds.stream_trades(trade_payloads(spark, d))


@query()
def p14_rest_trades(spark, d):
    rest = events(spark, d).select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("value").cast("string").alias("price"), F.lit("1").alias("qty"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        (F.col("user_id") % 2 == 0).alias("isBuyerMaker"), F.when(F.col("user_id") % 3 == 0, False).alias("isBestMatch"),
    )
    return feeds.rest_trades(rest).drop("price")


@query("article_id", "source", "title", "n_chars", "url", "published_at", "author", "tags")
def p15_nested_articles(spark, d):
    """Documents as items of a nested feed, each beside a copy without a date; every third has no author."""
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = lambda date: F.struct(
        F.col("doc_id").cast("string").alias("_id"), date.alias("display_date"), F.concat(F.lit("/"), F.col("doc_id")).alias("canonical_url"), F.struct(F.concat_ws(" ", F.lit("T"), "source").alias("basic")).alias("headlines"),
        F.struct(F.col("text").alias("basic")).alias("description"), F.struct(F.when(F.col("doc_id") % 3 > 0, F.array(F.struct(F.col("source").alias("name")))).alias("by")).alias("credits"),
        F.struct(F.array(F.struct(F.col("lang").alias("text")), F.struct(F.col("source").alias("text"))).alias("tags")).alias("taxonomy"),
    )
    payloads = A.table(spark, d, "documents").select(F.to_json(F.struct(F.array(item(when), item(F.lit(None).cast("string"))).alias("content_elements"))).alias("value"))
    return feeds.nested_articles(payloads, "nested", "https://n.example.org").withColumn("n_chars", F.length("content").cast("long"))


@query("article_id", "source", "title", "content", "url", "published_at")
def p16_rss_articles(spark, d):
    """Documents as items of RSS channels, each beside a copy whose date cannot be read."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "d MMM yyyy HH:mm:ss")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    date = F.concat(F.lit("Mon, "), when, F.lit(" +0000"))
    key = F.col("doc_id").cast("string")
    item = lambda at: tag("item", F.concat(tag("guid", key), tag("title", F.concat(F.lit("T&amp;A "), key)), tag("description", said), tag("link", F.concat(F.lit("https://r.example.org/"), key)), tag("pubDate", at)))
    return feeds.rss_articles(A.table(spark, d, "documents").select(tag("rss", tag("channel", F.concat(item(F.lit("yesterday")), item(date)))).alias("value")), "rss")


@query("article_id", "source", "title", "n_chars", "url", "published_at", "tags")
def p17_flat_articles(spark, d):
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"), F.lit("u").alias("url"), (F.lit(1704067200) + F.col("doc_id") * 60).alias("published_on"), F.concat_ws("|", "lang", "source").alias("categories"))
    payloads = A.table(spark, d, "documents").select(F.to_json(F.struct(F.array(item).alias("Data"))).alias("value"))
    return feeds.flat_articles(payloads, "flat").withColumn("n_chars", F.length("content").cast("long"))


@query("trade_id", "symbol", "price", "trade_time_ms", "trade_date")
def s3_backfill(spark, d):
    """Messages in files of JSON lines, read within dates."""
    lines = scratch_path(spark, "lines")
    A.raw_trades(events(spark, d)).select(F.col("value").cast("string")).write.text(lines)
    return files.backfill_trades(spark, lines, None, "2024-01-05", "2024-01-20").withColumn("trade_date", F.col("trade_date").cast("string"))


@query("event_id", "event_type", "value", "more")
def s7_st6_partitions(spark, d):
    """A table by event type; one type is written again with one more column, and old files have NULL there."""
    path, e = scratch_path(spark, "by-type"), events(spark, d).select("event_id", "event_type", "value")
    files.write_table(e, path, ["event_type"], "overwrite")
    files.write_table(e.filter("event_type = 'click'").withColumns({"value": F.col("value") + 1, "more": F.col("event_id") + 1}), path, ["event_type"], "overwrite")
    return files.read_table(spark, path, merge_schema=True)


def trade_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of trades. A file's place is given as a pattern, as a stream reads folders or patterns."""
    return A.trades(files.table_stream(spark, f"{d}/events.parque[t]", events(spark, d).schema))


def streamed(spark: SparkSession, stream: DataFrame, by: str, trigger: str | None = None) -> DataFrame:
    """All that a stream has now, by way of a partitioned table."""
    path = scratch_path(spark, "streamed")
    query = files.stream_to_table(stream, path, scratch_path(spark, "progress"), [by], trigger)
    if trigger:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    return files.read_table(spark, path, schema=stream.schema)


@query("symbol", "window_start", "open", "high", "low", "close", "volume", "vwap", "trade_count")
def st1_st2_bars_stream(spark, d):
    """Bars as a stream closes them: all but those that the watermark has not passed."""
    return streamed(spark, streams.bars_stream(trade_stream(spark, d), HOUR), "symbol")


@query("trade_id", "symbol", "price", "quantity")
def s4_s6_st4_trades_to_table(spark, d):
    return streamed(spark, trade_stream(spark, d), "symbol")


@query("trade_id", "symbol", "price")
def st3_processing_time(spark, d):
    return streamed(spark, trade_stream(spark, d), "symbol", "1 second")


@query("trade_id", "symbol")
def st8_first_seen(spark, d):
    """Every trade twice in one stream, each once in the table."""
    twice = trade_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streamed(spark, streams.first_seen(twice, ["symbol", "trade_id"], "trade_timestamp", "1 hour"), "symbol")


def slices(spark: SparkSession, d: str, n: int = 4) -> list[DataFrame]:
    """The trades in stretches of time, which arrive one after the other."""
    t = trades(spark, d)
    low, high = t.agg(F.min(F.unix_micros("trade_timestamp")), F.max(F.unix_micros("trade_timestamp"))).first()
    place = F.least(F.floor((F.unix_micros("trade_timestamp") - low) * n / F.lit(max(high - low, 1))), F.lit(n - 1))
    return [t.filter(place == k) for k in range(n)]


def arriving(spark: SparkSession, parts: list[DataFrame], stops: list[int], run: Callable[[DataFrame], object]) -> None:
    """Runs a stream that ends when it has read all that is there, and starts it again on its checkpoint when more of `parts`
    have arrived, up to each of `stops`."""
    root, at = scratch_path(spark, "arriving"), 0
    for stop in stops:
        for k in range(at, stop):
            parts[k].write.parquet(f"{root}/{k}")
        run(files.table_stream(spark, f"{root}/*", parts[0].schema))
        at = stop


def series_stream(spark: SparkSession, d: str, operator: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0) -> DataFrame:
    """A series operator over the bars of a stream of trades that stops after half of them and starts again on its checkpoint."""
    path, progress = scratch_path(spark, "series"), scratch_path(spark, "progress")
    arriving(spark, slices(spark, d), [2, 4], lambda t: streams.series_stream(streams.bars_stream(t, HOUR), operator, path, progress, back, ahead).awaitTermination())
    return streams.series_rows(spark, path)


@query("symbol", "window_start", "rsi")
def st9_rsi_stream(spark, d):
    return series_stream(spark, d, W.rsi, back=14)


@query()
def st9_ema_stream(spark, d):
    path, progress = scratch_path(spark, "series"), scratch_path(spark, "progress")
    arriving(spark, slices(spark, d), [2, 4], lambda t: streams.ema_stream(streams.bars_stream(t, HOUR), 20, path, progress).awaitTermination())
    return streams.series_rows(spark, path)


@query("symbol", "window_start", "close_normalised", "volume_normalised")
def st9_z_score_stream(spark, d):
    return series_stream(spark, d, lambda b: W.normalised(b, ["close", "volume"]), back=20)


@query("symbol", "window_start", "price_change_pct_lag_1", "price_change_pct_lag_3", "price_change_pct_lag_5", "volume_change_pct", "volatility_change", "ema_short", "ema_long", "ema_crossover", "rolling_mean_price", "rolling_std_price", "momentum", "vwap_deviation", "volatility")
def st9_time_series_stream(spark, d):
    return series_stream(spark, d, W.time_series, back=19)


@query("symbol", "window_start", *M.ANOMALY)
def st9_anomaly_features_stream(spark, d):
    return series_stream(spark, d, W.anomaly_features, back=119)


@query("symbol", "window_start", "direction")
def st9_labels_stream(spark, d):
    """Labels look five bars ahead: a bar waits until they are there."""
    return series_stream(spark, d, W.labelled, back=0, ahead=5)


@query("symbol", "window_start", "market_signal", "sentiment_momentum", "sentiment_signal", "sentiment_signal_normalised", "timeseries_signal", "weighted_composite_signal", "signal_strength", "signal_direction")
def st9_fusion_stream(spark, d):
    news = bar_sentiment(spark, d)
    return series_stream(spark, d, lambda b: G.fused(b, news), back=40)


@query("trade_id", "symbol", "price", "quantity")
def st4_restarted(spark, d):
    """A sink that stops after half of the trades and starts again on its checkpoint: each trade once."""
    path, progress = scratch_path(spark, "restarted"), scratch_path(spark, "progress")
    arriving(spark, slices(spark, d), [2, 4], lambda t: files.stream_to_table(t, path, progress, ["symbol"]).awaitTermination())
    return files.read_table(spark, path)


@query()
def st5_files_per_trigger(spark, d):
    """Four files of trades, of which a trigger takes one: the rows of each micro-batch."""
    root, path = scratch_path(spark, "files"), scratch_path(spark, "batches")
    parts = slices(spark, d)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{root}/{k}")
    stream = files.table_stream(spark, f"{root}/*", parts[0].schema, files_per_trigger=1)
    count = lambda df, n: df.agg(F.lit(n).alias("batch"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows/{n}")
    streams.each_batch(stream, count, path, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(f"{path}/rows/*")


@query()
def s9_in_batches(spark, d):
    """All events as messages, in batches of 10,000 bytes at most: how many messages by key they hold, and whether all batches keep to it."""
    packed = files.in_batches(files.messages(events(spark, d), F.col("event_type")), 10_000)
    key = F.explode("keys").alias("key")
    return packed.select("bytes", key).groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), (F.max("bytes") <= 10_000).alias("bounded"))


@query("symbol", "close")
def st7_keep_latest(spark, d):
    """The newest trade of each symbol, merged batch by batch into a stored table."""
    path, progress = scratch_path(spark, "latest"), scratch_path(spark, "progress")
    rows = lambda t: t.select("symbol", F.col("price").alias("close"), F.struct("trade_timestamp", "trade_id").alias("order"))
    arriving(spark, slices(spark, d), [2, 4], lambda t: streams.keep_latest(rows(t), path, ["symbol"], "order", progress).awaitTermination())
    return stored.read_stored(spark, path)


@query()
def st8_bounded_by_count(spark, d):
    """All trades, and then all of them again, past a memory of the 50 newest ids of each quarter of a symbol: how often each came out."""
    path, progress, t = scratch_path(spark, "seen"), scratch_path(spark, "progress"), trades(spark, d)
    part = F.col("trade_id") % 4
    arriving(spark, [t, t], [1, 2], lambda s: files.stream_to_table(streams.seen_once(s.withColumn("part", part), ["symbol", "part"], "trade_id", 50), path, progress, ["symbol"]).awaitTermination())
    return files.read_table(spark, path).groupBy("symbol", "trade_id").agg(F.count(F.lit(1)).alias("times"))


@query("event_id", "event_type", "value", "kept", "same_again")
def t1_stored_upsert(spark, d):
    """All events in a stored table by type, and dearer clicks upserted, twice as the same batch. `kept`: the row's file is the one
    it was before the batch; `same_again`: it is the same after the batch came again."""
    path, e = scratch_path(spark, "stored"), events(spark, d).select("event_id", "event_type", "value")
    place = lambda name: spark.read.parquet(path).select("event_id", F.col("_metadata.file_name").alias(name))
    again = e.filter("event_type = 'click'").withColumn("value", F.col("value") + 1)
    stored.upsert_batch(e, path, 0, ["event_id"], by="event_type")
    first = scratch_path(spark, "files")
    place("first").write.parquet(first)
    stored.upsert_batch(again, path, 1, ["event_id"], by="event_type")
    second = scratch_path(spark, "files")
    place("second").write.parquet(second)
    stored.upsert_batch(again, path, 1, ["event_id"], by="event_type")
    rows = stored.read_stored(spark, path).join(place("third"), "event_id").join(spark.read.parquet(first), "event_id").join(spark.read.parquet(second), "event_id")
    return rows.withColumns({"kept": F.col("first") == F.col("second"), "same_again": F.col("second") == F.col("third")})


@query("event_id", "value")
def t2_stored_latest(spark, d):
    """The merge of `t2_merged_latest` into a stored table, in two batches."""
    path, (target, source) = scratch_path(spark, "stored"), target_and_source(spark, d)
    stored.latest_batch(target, path, 0, ["event_id"], "at")
    stored.latest_batch(source, path, 1, ["event_id"], "at")
    return stored.read_stored(spark, path)


@query()
def t7_interleaved(spark, d):
    """All events clustered by id and value together: the rows of each step of values in the rewritten table, and whether filters on
    each step meet fewer files, in sum, than in the table sorted by id alone."""
    many, by_id, by_both = scratch_path(spark, "many"), scratch_path(spark, "by-id"), scratch_path(spark, "by-both")
    events(spark, d).select("event_id", "event_type", "value").repartition(16).write.parquet(many)
    one, both = K.compact(spark, many, by_id, ["event_id"], 16), K.compact(spark, many, by_both, ["event_id", "value"], 16, interleave=True)
    cells = spark.range(0, 500, 10).select(F.col("id").alias("low"), (F.col("id") + 10).alias("high"))
    rows = both.groupBy((F.floor(F.col("value") / 10) * 10).alias("low")).agg(F.count(F.lit(1)).alias("n"))
    before, after = (K.files_matching(t, "value", cells).agg(F.sum("files")).first()[0] for t in (one, both))
    return rows.withColumn("fewer", F.lit(after < before))


@query("article_id", "symbol", "sentiment_label", "sentiment_score", "sentiment_confidence")
def st10_news_stream(spark, d):
    docs = files.table_stream(spark, f"{d}/documents.parque[t]", A.table(spark, d, "documents").schema)
    return streamed(spark, S.scored_articles(P.silver_news(A.news(docs), SYMBOLS, NAMES), lexicon=LEXICON), "symbol")


@query("symbol", "window_start", "weighted_composite_signal", "signal_direction", "signal_date")
def g6_saved_fusion(spark, d):
    saved = G.run(bars(spark, d), bar_sentiment(spark, d), scratch_path(spark, "signals"))
    return saved.withColumn("signal_date", F.col("signal_date").cast("string"))


@query()
def o5_importances(spark, d):
    """Importances with their ranks; each event type's share of all value stands for a feature's."""
    e = events(spark, d)
    share = e.groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("v"))
    return M.ranked(share.crossJoin(F.broadcast(e.agg(F.sum("value").alias("total")))).select("feature", (F.col("v") / F.col("total")).alias("importance")))


@query()
def ml3_metrics(spark, d):
    """Metrics of fixed predictions: direction classes by value, predicted by the neighbouring quantity."""
    level = lambda c: F.when(c < 100, 0.0).when(c < 300, 1.0).otherwise(2.0)
    return M.metrics(events(spark, d).select(level(F.col("value")).alias("label_index"), level(F.col("value") + F.col("user_id") % 7 * 20).alias("prediction")))


# --- rows only: no SQL can give these ---------------------------------------------------------------


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return M.detected(W.anomaly_features(bars(spark, d)), keys=[F.col("symbol"), F.unix_seconds("window_start")])


@query("symbol", "window_start", "is_anomaly", "severity", "anomaly_score", "anomaly_type")
def ml7_ml8_anomalies(spark, d):
    return anomalies(spark, d)


@query()
def a10_anomaly_summary(spark, d):
    return M.run_summary(anomalies(spark, d))


def direction_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Labelled bars with all features, earlier and later ones, and the features' names."""
    rows = W.labelled(G.momenta(G.simple_composite(S.with_sentiment(W.time_series(bars(spark, d)), bar_sentiment(spark, d)))).withColumn("sentiment_momentum", F.col("from_start")))
    features, path = [*M.MARKET, *M.SERIES, *M.SENTIMENT, "weighted_composite_signal"], scratch_path(spark, "features")
    rows.select("symbol", "window_start", "direction", *features).write.parquet(path)  # training reads them many times
    return *M.chronological(spark.read.parquet(path)), features


@query()
def o5_permutation_importances(spark, d):
    """What each feature of a forest is worth on the later bars."""
    early, late, features = direction_rows(spark, d)
    return M.permutation_importances(M.train(early, features, classifier=M.forest(10)), late, features)


@query("doc_id", "label", "score", "confidence")
def ud3_text_model(spark, d):
    """Sentiment of all documents, whole texts, by a model of good and bad ones that is fitted on their labels."""
    docs = A.table(spark, d, "documents")
    labelled = docs.join(A.table(spark, d, "labels"), "doc_id")
    return S.model_scored(docs, S.text_model(labelled, "text", F.col("quality") == 1), key="doc_id", text="text", longest=None)


@query()
def ml1_ml5_direction_model(spark, d):
    """Metrics of a forest that is trained on the earlier part of each symbol's bars."""
    early, late, features = direction_rows(spark, d)
    return M.metrics(M.train(early, features).transform(late))
