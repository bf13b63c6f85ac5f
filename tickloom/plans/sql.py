"""DuckDB SQL of the registered queries, written on its own. `view` presents rows as `shown` does."""

from __future__ import annotations


def view(inner: str, keep: str = "", numbers: str = "", times: str = "", lists: str = "") -> str:
    """Columns as they are, numbers rounded to 6 digits, times and lists as text."""
    out = [c for c in keep.split()]
    out += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in numbers.split()]
    out += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times.split()]
    out += [f"array_to_string({c}, ',') AS {c}" for c in lists.split()]
    return f"SELECT {', '.join(out)} FROM ({inner})"


TRADES = """trades AS (SELECT event_type AS symbol, event_id AS trade_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity,
 user_id % 2 = 0 AS is_buyer_maker, CAST(ts AS TIMESTAMP) AS trade_timestamp FROM events)"""


def sums(name: str, source: str, start: str) -> str:
    return f"""{name} AS (SELECT symbol, {start} AS window_start, arg_min(price, row(trade_timestamp, trade_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, row(trade_timestamp, trade_id)) AS close, sum(quantity) AS volume, sum(price * quantity) AS quote_volume, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS buy_volume,
 sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END) AS sell_volume, count(*) AS trade_count, avg(price) AS mean, stddev_samp(price) AS dev FROM {source} GROUP BY ALL)"""


def derived(name: str, source: str, label: str, hours: int, vwap: str, volatility: str) -> str:
    return f"""{name} AS (SELECT symbol, '{label}' AS interval, window_start, window_start + INTERVAL {hours} HOUR AS window_end, open, high, low, close, volume, quote_volume, buy_volume, sell_volume, trade_count,
 {vwap} AS vwap, {volatility} AS volatility, CASE WHEN volume > 0 THEN buy_volume / volume ELSE 0.5 END AS buy_sell_ratio, close - open AS price_change,
 CASE WHEN open > 0 THEN (close - open) * 100 / open ELSE 0 END AS price_change_pct, CASE WHEN low > 0 THEN (high - low) * 100 / low ELSE 0 END AS high_low_range, trade_count / {hours * 3600}.0 AS trade_intensity FROM {source})"""


BARS = ",\n".join(
    [TRADES, sums("s1", "trades", "date_trunc('hour', trade_timestamp)"), derived("bars", "s1", "1h", 1, "CASE WHEN volume > 0 THEN quote_volume / volume ELSE close END", "CASE WHEN mean > 0 THEN dev * 100 / mean ELSE 0 END")]
)
ROLLED = """s4 AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, window_start) AS window_start, arg_min(open, window_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, window_start) AS close,
 sum(volume) AS volume, sum(quote_volume) AS quote_volume, sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, sum(vwap * volume) AS weighted, avg(volatility) AS vol
 FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, window_start))"""
SERIES = "WINDOW w AS (PARTITION BY symbol ORDER BY window_start), r4 AS (PARTITION BY symbol ORDER BY window_start ROWS 4 PRECEDING), r9 AS (PARTITION BY symbol ORDER BY window_start ROWS 9 PRECEDING), r13 AS (PARTITION BY symbol ORDER BY window_start ROWS 13 PRECEDING), r19 AS (PARTITION BY symbol ORDER BY window_start ROWS 19 PRECEDING), r20 AS (PARTITION BY symbol ORDER BY window_start ROWS 20 PRECEDING), r59 AS (PARTITION BY symbol ORDER BY window_start ROWS 59 PRECEDING), r119 AS (PARTITION BY symbol ORDER BY window_start ROWS 119 PRECEDING)"
BAR_NUMBERS = "open high low close volume quote_volume buy_volume sell_volume vwap volatility buy_sell_ratio price_change price_change_pct high_low_range trade_intensity"


def pct(new: str, old: str, otherwise: str = "0") -> str:
    return f"CASE WHEN {old} > 0 THEN ({new} - {old}) * 100 / {old} ELSE {otherwise} END"


def z(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER r20 > 0 THEN ({x} - avg({x}) OVER r20) / (stddev_samp({x}) OVER r20) ELSE 0 END"


NEWS = r"""news AS (SELECT source, CAST(doc_id AS VARCHAR) AS article_id, substring(text, 1, 80) AS raw_title, text AS raw_content, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS published_at, lang,
 trim(regexp_replace(regexp_replace(substring(text, 1, 80), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ') AS title, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' ') AS content FROM documents),
good AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(upper(title || ' ' || content), '\b(THAT|WITH|THIS|FROM|WERE)\b', 1), lambda x: CASE WHEN x = 'WERE' THEN 'THIS' ELSE x END))) AS mentioned,
 len(string_split_regex(content, '\s+')) AS word_count, sha256(title || ':' || substring(content, 1, 1000)) AS content_hash FROM news WHERE length(raw_title) > 10 AND length(raw_content) > 50)"""


def hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words) + ")"


SCORED = rf"""counted AS (SELECT *, {hits("title || ' ' || content", ("thing", "with", "from"))} AS p, {hits("title || ' ' || content", ("tion", "this"))} AS n FROM good),
judged AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END AS score, CASE WHEN p + n > 0 THEN least(0.5 + (p + n) * 0.1, 0.9) ELSE 0.5 END AS confidence FROM counted),
scored AS (SELECT article_id, source, title, unnest(mentioned) AS symbol, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
 CAST(score AS DOUBLE) AS sentiment_score, CAST(confidence AS DOUBLE) AS sentiment_confidence, published_at AS published_timestamp, word_count, content_hash FROM judged)"""
WINDOWS = """sw AS (SELECT symbol, time_bucket(INTERVAL 15 MINUTE, published_timestamp) AS window_start, avg(sentiment_score) AS mean_score, sum(sentiment_score * sentiment_confidence) / sum(sentiment_confidence) AS weighted_score,
 avg(sentiment_confidence) AS sentiment_confidence, count(*) AS article_count, count(*) FILTER (sentiment_label = 'positive') AS positive_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count,
 count(*) FILTER (sentiment_label = 'neutral') AS neutral_count FROM scored GROUP BY ALL)"""
#: Sentiment of bars: a score per hour and symbol out of the documents of that hour, dealt to symbols by doc_id.
BAR_SENTIMENT = rf"""dealt AS (SELECT ['click', 'view', 'purchase', 'signup', 'error'][1 + doc_id % 5] AS symbol, date_trunc('hour', TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id) AS window_start, {hits("text", ("thing", "with"))} AS p, {hits("text", ("tion", "this"))} AS n FROM documents),
sent AS (SELECT symbol, window_start, avg(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END) AS sentiment_score, avg(CASE WHEN p + n > 0 THEN least(0.5 + (p + n) * 0.1, 0.9) ELSE 0.5 END) AS sentiment_confidence, count(*) AS article_count FROM dealt GROUP BY ALL),
joined AS (SELECT b.*, coalesce(s.sentiment_score, 0.0) AS sentiment_score, coalesce(s.sentiment_confidence, 0.5) AS sentiment_confidence, coalesce(s.article_count, 0) AS article_count
 FROM bars b LEFT JOIN sent s ON s.symbol = b.symbol AND s.window_start = b.window_start)"""
FUSION = f"""m0 AS (SELECT *, {pct("close", "vwap")} AS vwap_deviation FROM joined),
m1 AS (SELECT *, 0.4 * ({z("price_change_pct")}) + 0.3 * ({z("vwap_deviation")}) + 0.3 * ({z("buy_sell_ratio")}) AS market_signal,
 sentiment_score - coalesce(lag(sentiment_score) OVER w, 0) AS sentiment_momentum, CASE WHEN article_count > 0 THEN sentiment_score * sentiment_confidence ELSE lag(sentiment_score) OVER w * 0.9 END AS sentiment_signal,
 CASE WHEN avg(close) OVER r19 > 0 THEN (avg(close) OVER r4 - avg(close) OVER r19) * 100 / (avg(close) OVER r19) ELSE 0 END AS ema_crossover, {pct("close", "lag(close, 5) OVER w")} AS price_momentum,
 CASE WHEN lag(volatility) OVER w > 0 THEN (volatility - lag(volatility) OVER w) / (lag(volatility) OVER w) ELSE 0 END AS volatility_trend FROM m0 {SERIES}),
m2 AS (SELECT *, {z("sentiment_signal")} AS sentiment_signal_normalised, 0.5 * ({z("ema_crossover")}) + 0.3 * ({z("price_momentum")}) + 0.2 * volatility_trend AS timeseries_signal FROM m1 {SERIES}),
fused AS (SELECT *, 0.5 * market_signal + 0.3 * sentiment_signal_normalised + 0.2 * timeseries_signal AS raw FROM m2),
final AS (SELECT symbol, window_start, coalesce(market_signal, 0) AS market_signal, sentiment_momentum, coalesce(sentiment_signal, 0) AS sentiment_signal, coalesce(sentiment_signal_normalised, 0) AS sentiment_signal_normalised, coalesce(timeseries_signal, 0) AS timeseries_signal,
 coalesce(raw, 0) AS weighted_composite_signal, coalesce(abs(raw), 0) AS signal_strength, CASE WHEN raw > 0.1 THEN 'UP' WHEN raw < -0.1 THEN 'DOWN' ELSE 'NEUTRAL' END AS signal_direction, close, price_change_pct, volume, trade_count FROM fused)"""
ANOMALY = f"""a0 AS (SELECT *, {", ".join(f"({c} - avg({c}) OVER r59) / (stddev_samp({c}) OVER r59 + 1e-8) AS {c}_zscore" for c in ("volume", "trade_count", "price_change_pct", "high_low_range"))},
 abs(buy_sell_ratio - 0.5) * 2 AS buy_sell_imbalance, stddev_samp(volume) OVER r59 / (volume / (trade_count + 1) + 1e-8) AS cv, trade_count / (avg(trade_count) OVER r119 + 1) AS spike FROM bars {SERIES}),
anomaly AS (SELECT *, 1 - CASE WHEN cv < 0 THEN 0 WHEN cv > 1 THEN 1 ELSE cv END AS trade_size_uniformity, CASE WHEN spike > 10 THEN 10 ELSE spike END AS trade_frequency_spike FROM a0)"""
LOG = """log AS (SELECT event_id % 500 AS k, value AS v, CAST(event_id // 500 AS BIGINT) AS version, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (event_id // 500) AS committed_at, CASE WHEN user_id % 10 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM events)"""


def as_of(where: str) -> str:
    return f"(SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS r FROM log WHERE {where}) WHERE r = 1 AND op <> 'delete')"


def bars_query(columns: str, keep: str = "symbol", numbers: str = "", times: str = "window_start", extra: str = "", source: str = "bars", tail: str = SERIES) -> str:
    return view(f"WITH {BARS}{extra} SELECT {columns} FROM {source} {tail}", keep, numbers, times)


UPSERT = "tgt AS (SELECT event_id, value, 0 AS at FROM events), src AS (SELECT event_id * 2 AS event_id, value + 100 AS value, user_id % 2 AS at FROM events)"
#: Documents as articles of feeds.
ITEMS = "i AS (SELECT *, CAST(doc_id AS VARCHAR) AS article_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS published_at FROM documents)"
SQL: dict[str, str] = {
    "a1_ohlc": bars_query("*", "symbol trade_count", "open high low close volume quote_volume", "window_start window_end", tail=""),
    "a2_vwap": view(f"WITH {BARS} SELECT symbol, window_start, window_end, CASE WHEN volume > 0 THEN quote_volume / volume END AS vwap, volume FROM bars", "symbol", "vwap volume", "window_start window_end"),
    "a3_volatility": view(
        f"WITH {TRADES} SELECT symbol, date_trunc('hour', trade_timestamp) AS window_start, date_trunc('hour', trade_timestamp) + INTERVAL 1 HOUR AS window_end, CASE WHEN avg(price) > 0 THEN stddev_samp(price) * 100 / avg(price) END AS volatility, stddev_samp(CASE WHEN price > 0 THEN ln(price) END) AS log_price_stddev, count(*) AS sample_count FROM trades GROUP BY ALL",
        "symbol sample_count", "volatility log_price_stddev", "window_start window_end",
    ),
    "a4_order_flow": view(f"WITH {BARS} SELECT *  FROM bars", "symbol", "buy_volume sell_volume buy_sell_ratio", "window_start window_end"),
    "a5_bar_features": view(f"WITH {BARS} SELECT * FROM bars", "symbol interval trade_count", BAR_NUMBERS, "window_start window_end"),
    "a6_rolled_up": view(f"WITH {BARS}, {ROLLED}, {derived('rolled', 's4', '4h', 4, 'CASE WHEN volume > 0 THEN weighted / volume ELSE close END', 'vol')} SELECT * FROM rolled", "symbol interval trade_count", BAR_NUMBERS, "window_start window_end"),
    "a7_sentiment_windows": view(
        f"WITH {NEWS}, {SCORED}, {WINDOWS} SELECT *, window_start + INTERVAL 15 MINUTE AS window_end, CASE WHEN positive_count >= negative_count AND positive_count >= neutral_count THEN 'positive' WHEN negative_count > positive_count AND negative_count > neutral_count THEN 'negative' ELSE 'neutral' END AS dominant_label FROM sw",
        "symbol article_count positive_count negative_count neutral_count dominant_label", "mean_score weighted_score sentiment_confidence", "window_start window_end",
    ),
    "a8_mean_sentiment": view(f"WITH {BARS}, {BAR_SENTIMENT} SELECT * FROM sent", "symbol article_count", "sentiment_score sentiment_confidence", "window_start"),
    "a9_profile": view(
        f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.95) AS q95, quantile_cont({c}, 0.99) AS q99 FROM bars" for c in ("volume", "trade_count", "price_change_pct", "high_low_range", "buy_sell_ratio")),
        "feature", "mean std q95 q99",
    ),
    "a11_ingestion_summary": "SELECT event_type AS source, CAST(sum(n) AS BIGINT) AS fetched, CAST(sum(ok) AS BIGINT) AS valid, CAST(sum(greatest(ok - 1, 0)) AS BIGINT) AS duplicate, CAST(sum(least(ok, 1)) AS BIGINT) AS published FROM (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events GROUP BY ALL) GROUP BY ALL",
    "a12_market_stats": view(
        f"WITH {BARS}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY window_start DESC) = 1) SELECT sum(volume) AS total_volume, CAST(sum(trade_count) AS BIGINT) AS total_trades, avg(price_change_pct) AS mean_change, CASE WHEN avg(price_change_pct) > 1 THEN 'Bullish' WHEN avg(price_change_pct) < -1 THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM l",
        "total_trades sentiment", "total_volume mean_change",
    ),
    "a13_label_counts": f"WITH {NEWS}, x AS (SELECT {hits('content', ('thing', 'with', 'from'))} AS p, {hits('content', ('tion', 'this'))} AS n FROM good) SELECT count(*) FILTER (p > n) AS positive_count, count(*) FILTER (n > p) AS negative_count, count(*) FILTER (n = p) AS neutral_count FROM x",
    "a14_market_overview": view(
        f"WITH {BARS}, {BAR_SENTIMENT}, {FUSION}, l AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY window_start DESC) = 1), al AS (SELECT event_type AS symbol, count(*) AS n FROM events WHERE value > 400 AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' GROUP BY ALL) SELECT l.symbol, close AS price, price_change_pct AS change_pct, volume, signal_direction AS prediction, signal_strength AS confidence, coalesce(al.n, 0) AS recent_anomalies, CAST(sum(CASE WHEN signal_direction = 'UP' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS bullish_count, CAST(sum(CASE WHEN signal_direction = 'DOWN' THEN 1 ELSE 0 END) OVER () AS BIGINT) AS bearish_count FROM l LEFT JOIN al ON al.symbol = l.symbol",
        "symbol prediction recent_anomalies bullish_count bearish_count", "price change_pct volume confidence",
    ),
    "w1_distinct_trades": view("SELECT event_type AS symbol, event_id AS trade_id, CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END AS price FROM events", "symbol trade_id", "price"),
    "w2_distinct_news": f"WITH {NEWS} SELECT content_hash, arg_min(article_id, row(-CAST(article_id AS BIGINT), article_id)) AS article_id FROM good GROUP BY ALL",
    "w3_w11_time_series": bars_query(
        "symbol, window_start, "
        + ", ".join(
            f"coalesce({x}, 0) AS {n}"
            for n, x in {
                "price_change_pct_lag_1": "lag(price_change_pct, 1) OVER w", "price_change_pct_lag_3": "lag(price_change_pct, 3) OVER w", "price_change_pct_lag_5": "lag(price_change_pct, 5) OVER w",
                "volume_change_pct": pct("volume", "lag(volume) OVER w"), "volatility_change": pct("volatility", "lag(volatility) OVER w"), "ema_short": "avg(close) OVER r4", "ema_long": "avg(close) OVER r19",
                "ema_crossover": "CASE WHEN avg(close) OVER r4 > avg(close) OVER r19 THEN 1.0 ELSE -1.0 END", "rolling_mean_price": "avg(close) OVER r9", "rolling_std_price": "stddev_samp(close) OVER r9",
                "momentum": pct("close", "lag(close, 5) OVER w"), "vwap_deviation": pct("close", "vwap"), "volatility": "volatility",
            }.items()
        ),
        numbers="price_change_pct_lag_1 price_change_pct_lag_3 price_change_pct_lag_5 volume_change_pct volatility_change ema_short ema_long ema_crossover rolling_mean_price rolling_std_price momentum vwap_deviation volatility",
    ),
    "w12_labels": bars_query("symbol, window_start, direction", "symbol direction", source=f"(SELECT *, CASE WHEN {pct('f', 'close')} > 0.1 THEN 'UP' WHEN {pct('f', 'close')} < -0.1 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY window_start) AS f FROM bars) WHERE f IS NOT NULL)", tail=""),
    "w13_sentiment_momentum": view(f"WITH {BARS}, {BAR_SENTIMENT} SELECT symbol, window_start, sentiment_score - coalesce(lag(sentiment_score) OVER w, sentiment_score) AS from_start, sentiment_score - coalesce(lag(sentiment_score) OVER w, 0) AS from_zero FROM joined {SERIES}", "symbol", "from_start from_zero", "window_start"),
    "w14_z_score": bars_query(f"symbol, window_start, {z('close')} AS close_normalised, {z('volume')} AS volume_normalised", numbers="close_normalised volume_normalised"),
    "w17_simple_changes": bars_query(
        "symbol, window_start, CASE WHEN vwap <> 0 THEN (close - vwap) * 100 / vwap END AS vwap_deviation, lag(price_change_pct, 1) OVER w AS price_change_pct_lag1, lag(price_change_pct, 2) OVER w AS price_change_pct_lag2, lag(price_change_pct, 3) OVER w AS price_change_pct_lag3, (volume - lag(volume) OVER w) * 100 / nullif(lag(volume) OVER w, 0) AS volume_change_pct, volatility - lag(volatility) OVER w AS volatility_change",
        numbers="vwap_deviation price_change_pct_lag1 price_change_pct_lag2 price_change_pct_lag3 volume_change_pct volatility_change",
    ),
    "w18_w21_anomaly_features": view(f"WITH {BARS}, {ANOMALY} SELECT * FROM anomaly", "symbol", "volume_zscore trade_count_zscore price_change_pct_zscore high_low_range_zscore buy_sell_imbalance trade_size_uniformity trade_frequency_spike", "window_start"),
    "w22_rsi": view(
        f"WITH {BARS}, d AS (SELECT symbol, window_start, close - lag(close) OVER w AS d FROM bars {SERIES}) SELECT symbol, window_start, CASE WHEN count(d) OVER r13 < 14 THEN 50 WHEN avg(greatest(d, 0)) OVER r13 + avg(greatest(-d, 0)) OVER r13 = 0 THEN 50 ELSE 100 * avg(greatest(d, 0)) OVER r13 / (avg(greatest(d, 0)) OVER r13 + avg(greatest(-d, 0)) OVER r13) END AS rsi FROM d {SERIES}",
        "symbol", "rsi", "window_start",
    ),
    "w23_ema": view(
        f"WITH RECURSIVE {BARS}, n AS (SELECT symbol, window_start, close, row_number() OVER (PARTITION BY symbol ORDER BY window_start) AS k FROM bars), e AS (SELECT symbol, window_start, k, close AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.window_start, n.k, e.ema * (1 - 2.0 / 21) + n.close * 2.0 / 21 FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1) SELECT symbol, window_start, ema FROM e",
        "symbol", "ema", "window_start",
    ),
    "w24_bollinger": bars_query("symbol, window_start, avg(close) OVER r19 AS bb_middle, avg(close) OVER r19 + 2 * stddev_pop(close) OVER r19 AS bb_upper, avg(close) OVER r19 - 2 * stddev_pop(close) OVER r19 AS bb_lower, 4 * stddev_pop(close) OVER r19 / avg(close) OVER r19 AS bb_bandwidth", numbers="bb_middle bb_upper bb_lower bb_bandwidth"),
    "g1_g4_fusion": view(f"WITH {BARS}, {BAR_SENTIMENT}, {FUSION} SELECT * FROM final", "symbol signal_direction", "market_signal sentiment_momentum sentiment_signal sentiment_signal_normalised timeseries_signal weighted_composite_signal signal_strength", "window_start"),
    "g5_simple_composite": view(f"WITH {BARS}, {BAR_SENTIMENT} SELECT symbol, window_start, 0.5 * price_change_pct + 0.3 * sentiment_score + 0.2 * ({pct('close', 'lag(close, 5) OVER w')}) AS weighted_composite_signal FROM joined {SERIES}", "symbol", "weighted_composite_signal", "window_start"),
    "c2_anomaly_type": view(
        f"WITH {BARS}, {ANOMALY}, x AS (SELECT *, coalesce(volume_zscore, 0) AS v, coalesce(price_change_pct_zscore, 0) AS p, coalesce(trade_size_uniformity, 0) AS u FROM anomaly) SELECT symbol, window_start, CASE WHEN NOT volume > 20 THEN NULL WHEN v > 3 AND abs(p) < 1 THEN 'wash_trade' WHEN p > 3 AND v > 2 THEN 'pump' WHEN p < -3 AND v > 2 THEN 'dump' WHEN u > 0.9 THEN 'wash_trade' WHEN buy_sell_imbalance > 0.8 THEN 'price_manipulation' WHEN v > 4 THEN 'volume_spike' ELSE 'unknown' END AS anomaly_type FROM x",
        "symbol anomaly_type", "", "window_start",
    ),
    "c3_c5_trend_and_risk": view(
        f"""WITH {BARS}, {BAR_SENTIMENT}, j AS (SELECT bars.*, coalesce(sent.sentiment_score, 0) AS score FROM bars LEFT JOIN sent USING (symbol, window_start)),
 d AS (SELECT *, close - lag(close) OVER w AS d, lag(close, 5) OVER w AS c5 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY window_start)),
 g AS (SELECT *, avg(greatest(d, 0)) OVER two AS up, avg(greatest(-d, 0)) OVER two AS down, count(d) OVER two AS n FROM (SELECT *, d FROM d) WINDOW two AS (PARTITION BY symbol ORDER BY window_start ROWS 1 PRECEDING)),
 x AS (SELECT *, round(CASE WHEN n < 2 OR up + down = 0 THEN 50 ELSE 100 * up / (up + down) END, 6) AS rsi,
  CASE WHEN trade_count % 3 > 0 THEN round(0.5 * price_change_pct + 0.3 * score + 0.2 * {pct('close', 'c5')}, 6) / 100 END AS weighted FROM g)
 SELECT symbol, window_start, CASE WHEN rsi > 70 THEN 'OVERBOUGHT' WHEN rsi < 30 THEN 'OVERSOLD' WHEN price_change_pct > 0.5 THEN 'BULLISH' WHEN price_change_pct < -0.5 THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend,
  CASE WHEN coalesce(weighted, buy_sell_ratio - 0.5) > 0.3 THEN 'BULLISH' WHEN coalesce(weighted, buy_sell_ratio - 0.5) < -0.3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS outlook,
  CASE WHEN trade_count > 8 THEN 'HIGH' WHEN coalesce(volatility, 0) > 0.05 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN trade_count > 8 THEN 'Reduce position size' ELSE 'Standard position' END AS advice FROM x""",
        "symbol trend outlook risk advice", "", "window_start",
    ),
    "c6_c7_stated": view(
        r"""WITH c AS (SELECT conv_id, turn, upper(CASE turn % 3 WHEN 0 THEN 'Buy ' WHEN 1 THEN 'sell ' ELSE '' END || coalesce(text, '')) AS t, turn * 7 % 100 AS n, (conv_id + turn) % 9 AS form, lower(coalesce(text, '')) AS low, coalesce(text, '') AS text FROM conversations),
 o AS (SELECT *, CASE WHEN regexp_matches(text, '[Cc]onfidence[:\s]+\d{1,3}%') THEN regexp_extract(text, '[Cc]onfidence[:\s]+(\d{1,3})%', 1)::DOUBLE WHEN regexp_matches(text, '\d{1,3}%\s*[Cc]onfidence') THEN regexp_extract(text, '(\d{1,3})%\s*[Cc]onfidence', 1)::DOUBLE END AS p,
  CASE WHEN regexp_matches(text, '[Cc]onfidence[:\s]+0\.\d{1,2}') THEN regexp_extract(text, '[Cc]onfidence[:\s]+(0\.\d{1,2})', 1)::DOUBLE END AS q,
  CASE WHEN low LIKE '%strong buy%' OR low LIKE '%highly confident%' OR low LIKE '%very bullish%' THEN 0.85 WHEN low LIKE '%buy%' OR low LIKE '%bullish%' OR low LIKE '%confident%' THEN 0.7
   WHEN low LIKE '%hold%' OR low LIKE '%neutral%' OR low LIKE '%wait%' THEN 0.5 WHEN low LIKE '%sell%' OR low LIKE '%bearish%' THEN 0.6 ELSE 0.5 END AS words FROM c)
 SELECT conv_id, turn, CASE WHEN t LIKE '%BUY%' AND t NOT LIKE '%SELL%' THEN 'UP' WHEN t LIKE '%SELL%' AND t NOT LIKE '%BUY%' THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, n / CASE WHEN n > 1 THEN 100.0 ELSE 1.0 END AS confidence,
  CASE form WHEN 0 THEN n / CASE WHEN n > 1 THEN 100.0 ELSE 1.0 END WHEN 1 THEN n / CASE WHEN n > 1 THEN 100.0 ELSE 1.0 END WHEN 2 THEN n / CASE WHEN n > 9 THEN 100.0 ELSE 10.0 END WHEN 3 THEN 0.85 WHEN 4 THEN 0.7 WHEN 5 THEN 0.5 WHEN 6 THEN 0.6 WHEN 7 THEN 0.5
   ELSE coalesce(CASE WHEN p > 1 THEN p / 100 ELSE p END, q, words) END AS worded FROM o""",
        "conv_id turn direction", "confidence worded",
    ),
    "c1_dominant_label": "SELECT user_id, CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n > p AND n > u THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT user_id, count(*) FILTER (value > 300) AS p, count(*) FILTER (value < 100) AS n, count(*) FILTER (value >= 100 AND value <= 300) AS u FROM events GROUP BY ALL)",
    "o1_latest": view(f"WITH {BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY window_start DESC) = 1", "symbol interval trade_count", "close volume vwap", "window_start"),
    "o2_history": view(f"WITH {BARS} SELECT * FROM bars WHERE symbol = 'click' AND interval = '1h' ORDER BY window_start DESC LIMIT 60", "symbol interval", "close volume", "window_start"),
    "o3_alerts": view("SELECT event_id, event_type AS symbol, ts AS detected_at, value / 500 AS severity FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND value / 500 >= 0.5 ORDER BY ts DESC, event_type LIMIT 100", "event_id symbol", "severity", "detected_at"),
    "o4_of_symbols": view("SELECT event_id, event_type AS symbol FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW')", "event_id symbol"),
    "o6_newest_articles": view(f"WITH {NEWS} SELECT article_id, raw_title AS title, substring(raw_content, 1, 200) AS body, source, lang AS categories, published_at FROM news ORDER BY published_at DESC, article_id LIMIT 30", "article_id title body source categories", "", "published_at"),
    "u1_first_seen_news": f"WITH {NEWS} SELECT content_hash, min_by(article_id, row(published_at, article_id)) AS article_id FROM good GROUP BY ALL",
    "u2_bars_at": view(
        f"WITH {BARS}, {sums('s2', 'trades', 'time_bucket(INTERVAL 4 HOUR, trade_timestamp)')}, {sums('s3', 'trades', 'time_bucket(INTERVAL 1 DAY, trade_timestamp)')}, "
        + ", ".join(derived(n, s, label, h, "CASE WHEN volume > 0 THEN quote_volume / volume ELSE close END", "CASE WHEN mean > 0 THEN dev * 100 / mean ELSE 0 END") for n, s, label, h in (("b4", "s2", "4h", 4), ("b24", "s3", "1d", 24)))
        + " SELECT * FROM bars UNION ALL SELECT * FROM b4 UNION ALL SELECT * FROM b24",
        "symbol interval trade_count", BAR_NUMBERS, "window_start window_end",
    ),
    "j1_with_sentiment": view(f"WITH {BARS}, {BAR_SENTIMENT} SELECT * FROM joined", "symbol article_count", "close sentiment_score sentiment_confidence", "window_start"),
    "p3_p5_silver_trades": view("SELECT event_id AS trade_id, event_type AS symbol, CAST(value AS DECIMAL(18,8)) AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity, CAST(value AS DECIMAL(18,8)) * (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) AS quote_quantity, CASE WHEN user_id % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS side, ts AS trade_timestamp FROM events", "trade_id symbol side", "price quantity quote_quantity", "trade_timestamp"),
    "p6_p10_silver_news": view(f"WITH {NEWS} SELECT article_id, source, title, mentioned AS mentioned_symbols, CAST(word_count AS INTEGER) AS word_count, content_hash, published_at AS published_timestamp FROM good", "article_id source title word_count content_hash", "", "published_timestamp", "mentioned_symbols"),
    "p7_stripped_pages": r"SELECT page_id, regexp_replace(trim(regexp_replace(html, '\s+', ' ', 'g'), ' '), '<[^>]+>', '', 'g') AS content FROM pages",
    "p11_within_dates": view("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) <= DATE '2024-01-10'", "event_id", "", "ts"),
    "p18_published_since": f"WITH {NEWS} SELECT article_id FROM news WHERE published_at >= TIMESTAMP '2024-01-01 05:00:00' - INTERVAL 5 MINUTE",
    "p19_content_hash": "SELECT doc_id, sha256(substring(text, 1, 80) || ':' || substring(text, 1, 1000)) AS content_hash FROM documents",
    "p20_checked": "SELECT event_id, concat_ws(',', CASE WHEN value > 400 THEN 'value' END, CASE WHEN user_id < 10 THEN 'user' END) AS violations FROM events",
    "p23_ticker_features": view(
        "WITH x AS (SELECT o_orderkey AS symbol, o_totalprice AS price, o_totalprice * 1.1 AS high, o_totalprice * 0.9 AS low, CAST(o_orderkey % 7 AS DOUBLE) AS volume, o_totalprice * (o_orderkey % 7) AS quote, CAST(o_orderkey % 41 AS DOUBLE) / 2 - 10 AS c, o_custkey AS n FROM orders) SELECT symbol, price AS close, round(CASE WHEN volume > 0 THEN quote / volume ELSE price END, 2) AS vwap, round((high - low) / price, 6) AS volatility, round(CASE WHEN c > 5 THEN 75 + least(c, 25) WHEN c > -5 THEN 50 + c * 5 ELSE greatest(25 + c, 0) END, 1) AS rsi, round(greatest(0.1, least(0.9, 0.5 + c / 20)), 4) AS buy_sell_ratio, round(c, 2) AS price_change_pct, n AS trade_count FROM x",
        "symbol trade_count", "close vwap volatility rsi buy_sell_ratio price_change_pct",
    ),
    "p24_ticker_view": view("SELECT o_orderkey AS symbol, o_totalprice AS price, CAST(o_orderkey % 41 AS DOUBLE) / 2 - 10 AS change, o_custkey AS trades FROM orders", "symbol trades", "price change"),
    "p25_from_source": "SELECT doc_id FROM documents WHERE contains(lower(source), 'rc1')",
    "p26_body_pct": bars_query("symbol, window_start, CASE WHEN open = 0 THEN 0 ELSE (close - open) * 100 / open END AS body_pct", numbers="body_pct", tail=""),
    "p12_interval": view(f"WITH {BARS} SELECT symbol, window_start FROM bars", "symbol", "", "window_start"),
    "p21_book": view(
        "SELECT l_orderkey AS symbol, max(l_extendedprice) FILTER (l_linenumber % 2 = 0) AS best_bid, min(l_extendedprice) FILTER (l_linenumber % 2 = 1) AS best_ask, coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0) AS bid_volume, coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 1), 0) AS ask_volume, CASE WHEN sum(l_quantity) > 0 THEN (coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 0), 0) - coalesce(sum(l_quantity) FILTER (l_linenumber % 2 = 1), 0)) / sum(l_quantity) ELSE 0 END AS imbalance FROM lineitem GROUP BY l_orderkey",
        "symbol", "best_bid best_ask bid_volume ask_volume imbalance",
    ),
    "s5_read_table": view("SELECT event_id, value FROM events WHERE value > 100 AND event_type = 'click'", "event_id", "value"),
    "s8_messages": "SELECT event_type AS key, event_id FROM events",
    "ud2_lexicon": view(f"WITH {NEWS}, {SCORED} SELECT article_id, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label FROM judged", "article_id label", "score confidence"),
    "ud4_majority": f"SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT doc_id, {hits('text', ('thing', 'with', 'from'))} AS p, {hits('text', ('tion', 'this'))} AS n FROM documents)",
    "ud5_scored_articles": view(f"WITH {NEWS}, {SCORED} SELECT article_id, symbol, sentiment_label, sentiment_score, sentiment_confidence FROM scored", "article_id symbol sentiment_label", "sentiment_score sentiment_confidence"),
    "t1_upserted": view(f"WITH {UPSERT} SELECT event_id, value FROM src UNION ALL SELECT event_id, value FROM tgt WHERE event_id NOT IN (SELECT event_id FROM src)", "event_id", "value"),
    "t1_upsert_counts": f"WITH {UPSERT} SELECT count(t.event_id) AS updated, count(*) - count(t.event_id) AS inserted FROM src LEFT JOIN tgt t ON t.event_id = src.event_id",
    "t2_merged_latest": view(f"WITH {UPSERT} SELECT event_id, CASE WHEN t.at IS NULL OR src.at > t.at THEN src.value ELSE t.value END AS value FROM src FULL JOIN tgt t USING (event_id)", "event_id", "value"),
    "t3_at_version": view(f"WITH {LOG} SELECT * FROM {as_of('version <= 10')}", "k", "v"),
    "t4_at_timestamp": view(f"WITH {LOG} SELECT * FROM {as_of(chr(99) + 'ommitted_at <= TIMESTAMP ' + chr(39) + '2024-01-01 00:05:00' + chr(39))}", "k", "v"),
    "t5_compared": f"WITH {LOG}, a AS {as_of('version <= 5')}, b AS {as_of('version <= 10')} SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS rows_added, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_in_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_in_a, true AS same_schema",
    "t6_commit_history": view(f"WITH {LOG} SELECT version, max(committed_at) AS committed_at, count(*) AS changes, count(*) FILTER (op = 'delete') AS deletes FROM log GROUP BY version ORDER BY version DESC LIMIT 10", "version changes deletes", "", "committed_at"),
    "t8_reprocessed": view("SELECT event_type AS symbol, event_id AS trade_id, CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END AS price FROM events", "symbol trade_id", "price"),
    "g6_saved_fusion": view(f"WITH {BARS}, {BAR_SENTIMENT}, {FUSION} SELECT *, strftime(window_start, '%Y-%m-%d') AS signal_date FROM final", "symbol signal_direction signal_date", "weighted_composite_signal", "window_start"),
    "t7_compacted": view("SELECT event_id, event_type, value FROM events", "event_id event_type", "value"),
    "p22_depth": view(
        """WITH l AS (SELECT l_orderkey AS symbol, l_extendedprice AS p, l_quantity AS q, l_linenumber % 2 AS side FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 0 THEN -p ELSE p END, CASE WHEN side = 0 THEN -q ELSE q END) AS k FROM l),
 g AS (SELECT symbol, coalesce(max(p) FILTER (side = 0), 0) AS best_bid, coalesce(min(p) FILTER (side = 1), 0) AS best_ask, coalesce(sum(q) FILTER (side = 0 AND k <= 2), 0) AS bid_depth, coalesce(sum(q) FILTER (side = 1 AND k <= 2), 0) AS ask_depth FROM r GROUP BY symbol)
 SELECT *, round(best_ask - best_bid, 2) AS spread, CASE WHEN best_bid > 0 THEN round((best_ask - best_bid) * 100 / best_bid, 6) ELSE 0 END AS spread_pct, round(bid_depth / greatest(ask_depth, 0.001), 4) AS bid_ask_ratio FROM g""",
        "symbol", "best_bid best_ask spread spread_pct bid_depth ask_depth bid_ask_ratio",
    ),
    "p2_bronze_news": view("SELECT CAST(doc_id AS VARCHAR) AS article_id, source, substring(text, 1, 80) AS title, length(text) AS n_chars, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%d %H:%M:%S') AS published_at, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%d') AS publish_date, source AS kafka_key FROM documents", "article_id source title n_chars published_at publish_date kafka_key"),
    "p13_stream_trades": "SELECT event_id AS trade_id, event_type AS symbol, CAST(value AS VARCHAR) AS price, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS VARCHAR) AS quantity, user_id % 2 = 0 AS is_buyer_maker, epoch_ns(CAST(ts AS TIMESTAMP_NS)) // 1000000 AS event_time_ms FROM events",
    "p14_rest_trades": "SELECT 'trade' AS event_type, epoch_ns(CAST(ts AS TIMESTAMP_NS)) // 1000000 AS event_time_ms, event_type AS symbol, event_id AS trade_id, '1' AS quantity, CAST(0 AS BIGINT) AS buyer_order_id, CAST(0 AS BIGINT) AS seller_order_id, epoch_ns(CAST(ts AS TIMESTAMP_NS)) // 1000000 AS trade_time_ms, user_id % 2 = 0 AS is_buyer_maker, user_id % 3 <> 0 AS is_best_match FROM events",
    "p15_nested_articles": view(f"WITH {ITEMS} SELECT article_id, 'nested' AS source, concat_ws(' ', 'T', source) AS title, length(coalesce(text, '')) AS n_chars, 'https://n.example.org/' || article_id AS url, published_at, CASE WHEN doc_id % 3 > 0 THEN source END AS author, [coalesce(lang, ''), coalesce(source, '')] AS tags FROM i", "article_id source title n_chars url author", "", "published_at", "tags"),
    "p16_rss_articles": view(f"WITH {ITEMS} SELECT article_id, 'rss' AS source, 'T&A ' || article_id AS title, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' ') AS content, 'https://r.example.org/' || article_id AS url, published_at FROM i", "article_id source title content url", "", "published_at"),
    "p17_flat_articles": view(f"WITH {ITEMS} SELECT article_id, 'flat' AS source, coalesce(source, '') AS title, length(coalesce(text, '')) AS n_chars, 'u' AS url, published_at, string_split(concat_ws('|', lang, source), '|') AS tags FROM i", "article_id source title n_chars url", "", "published_at", "tags"),
    "s3_backfill": "SELECT event_id AS trade_id, event_type AS symbol, CAST(value AS VARCHAR) AS price, epoch_ns(CAST(ts AS TIMESTAMP_NS)) // 1000000 AS trade_time_ms, strftime(ts, '%Y-%m-%d') AS trade_date FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "s7_st6_partitions": view("SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value, CASE WHEN event_type = 'click' THEN event_id + 1 END AS more FROM events", "event_id event_type more", "value"),
    "st1_st2_bars_stream": view(f"WITH {BARS} SELECT * FROM bars WHERE window_end <= (SELECT max(trade_timestamp) FROM trades) - INTERVAL 10 SECOND", "symbol trade_count", "open high low close volume vwap", "window_start"),
    "s4_s6_st4_trades_to_table": view(f"WITH {TRADES} SELECT * FROM trades", "trade_id symbol", "price quantity"),
    "st3_processing_time": view(f"WITH {TRADES} SELECT * FROM trades", "trade_id symbol", "price"),
    "st8_first_seen": f"WITH {TRADES} SELECT DISTINCT trade_id, symbol FROM trades",
    "st7_keep_latest": view(f"WITH {TRADES} SELECT symbol, arg_max(price, row(trade_timestamp, trade_id)) AS close FROM trades GROUP BY symbol", "symbol", "close"),
    "o5_importances": view("SELECT event_type AS feature, sum(value) / (SELECT sum(value) FROM events) AS importance, CAST(row_number() OVER (ORDER BY sum(value) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY event_type", "feature rank", "importance"),
    "ml3_metrics": view(
        """WITH p AS (SELECT CASE WHEN value < 100 THEN 0 WHEN value < 300 THEN 1 ELSE 2 END AS l, CASE WHEN value + user_id % 7 * 20 < 100 THEN 0 WHEN value + user_id % 7 * 20 < 300 THEN 1 ELSE 2 END AS p FROM events),
 c AS (SELECT c, (SELECT count(*) FROM p WHERE l = c AND p.p = c) AS tp, (SELECT count(*) FROM p WHERE l = c) AS support, (SELECT count(*) FROM p WHERE p.p = c) AS named FROM (SELECT l AS c FROM p UNION SELECT p.p FROM p)),
 m AS (SELECT *, coalesce(tp / nullif(named, 0), 0) AS prec, coalesce(tp / nullif(support, 0), 0) AS rec, coalesce(2 * tp / nullif(named + support, 0), 0) AS f FROM c)
 SELECT sum(tp) / sum(support) AS accuracy, sum(prec * support) / sum(support) AS weighted_precision, sum(rec * support) / sum(support) AS weighted_recall, sum(f * support) / sum(support) AS weighted_f1,
  avg(prec) AS macro_precision, avg(rec) AS macro_recall, avg(f) AS macro_f1, CAST(sum(support) AS BIGINT) AS rows FROM m""",
        "rows", "accuracy weighted_precision weighted_recall weighted_f1 macro_precision macro_recall macro_f1",
    ),
}

SQL["st10_news_stream"] = SQL["ud5_scored_articles"]


def closed(name: str) -> str:
    """Of hourly bars' rows, those whose bar a stream of the trades has closed."""
    return f"SELECT * FROM ({SQL[name]}) WHERE CAST(window_start AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 10 SECOND"


SQL["st9_ema_stream"] = closed("w23_ema")
SQL["st9_rsi_stream"] = closed("w22_rsi")
SQL["st9_z_score_stream"] = closed("w14_z_score")
SQL["st9_time_series_stream"] = closed("w3_w11_time_series")
SQL["st9_anomaly_features_stream"] = closed("w18_w21_anomaly_features")
SQL["st9_fusion_stream"] = closed("g1_g4_fusion")
SQL["st9_labels_stream"] = f"""SELECT symbol, window_start, direction FROM ({SQL["w12_labels"]}) JOIN (
  SELECT symbol, window_start, lead(window_start, 5) OVER (PARTITION BY symbol ORDER BY window_start) AS future FROM ({SQL["p12_interval"]})) USING (symbol, window_start)
  WHERE CAST(future AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 10 SECOND"""
SQL["st4_restarted"] = SQL["s4_s6_st4_trades_to_table"]
SQL["st8_bounded_by_count"] = "SELECT event_type AS symbol, event_id AS trade_id, CASE WHEN row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id DESC) > 50 THEN 2 ELSE 1 END AS times FROM events"
SQL["t1_stored_upsert"] = view("SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value, event_type <> 'click' AS kept, TRUE AS same_again FROM events", "event_id event_type kept same_again", "value")
SQL["t2_stored_latest"] = SQL["t2_merged_latest"]
SQL["t7_interleaved"] = "SELECT CAST(floor(value / 10) * 10 AS BIGINT) AS low, count(*) AS n, TRUE AS fewer FROM events GROUP BY ALL"


def isolation(trees: int = 100, sample: int = 256, levels: int = 8, seed: int = 42) -> str:
    """The isolation forest over `anomaly`, grown level by level out of hashes of (seed, tree, node): CTEs up to `found`."""
    names = ["volume_zscore", "trade_count_zscore", "price_change_pct_zscore", "high_low_range_zscore", "buy_sell_imbalance", "trade_size_uniformity", "trade_frequency_spike"]
    fs = ", ".join(f"round((coalesce({c}, 0) - (SELECT coalesce(avg({c}), 0) FROM anomaly)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM anomaly), 6)" for c in names)
    unit = lambda what: f"('0x' || substr(md5('{seed}|' || tree || '|' || node || '|{what}'), 1, 13))::BIGINT / 4503599627370496.0"
    out = [
        f"x AS MATERIALIZED (SELECT *, [{fs}] AS fs, md5('{seed}|' || symbol || '|' || epoch(window_start)::BIGINT) AS m FROM anomaly)",
        "hx AS (SELECT fs, ('0x' || substr(m, 1, 8))::BIGINT % 2147483648 AS a, ('0x' || substr(m, 9, 8))::BIGINT % 2147483648 AS b FROM x)",
        f"drawn AS (SELECT tree, fs, (a + tree * b) % 2147483648 / 2147483648.0 AS u FROM hx, range({trees}) t(tree))",
        f"p0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS node, fs FROM drawn WHERE u < least(1.0, 2.0 * {sample} / (SELECT count(*) FROM x)) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, fs) <= {sample})",
        "sizes AS MATERIALIZED (SELECT tree, count(*) AS n FROM p0 GROUP BY tree)",
    ]
    low, high = (", ".join(f"{f}(fs[{k}])" for k in range(1, len(names) + 1)) for f in ("min", "max"))
    for at in range(levels + 1):
        out += [
            f"r{at} AS (SELECT tree, node, count(*) AS n, [{low}] AS lo, [{high}] AS hi FROM p{at} GROUP BY tree, node)",
            f"v{at} AS (SELECT r{at}.*, list_filter(range(1, {len(names) + 1}), lambda k: hi[k] > lo[k]) AS vs, {at} < ceil(log2(greatest(sizes.n, 2))) AND r{at}.n > 1 AS deep FROM r{at} JOIN sizes USING (tree))",
            f"k{at} AS (SELECT *, deep AND len(vs) > 0 AS inside, vs[floor({unit('feature')} * len(vs))::INT + 1] AS k FROM v{at})",
            f"n{at} AS MATERIALIZED (SELECT tree, node, n, inside, k, CASE WHEN inside THEN lo[k] + {unit('cut')} * (hi[k] - lo[k]) END AS cut FROM k{at})",
        ]
        if at < levels:
            out.append(f"p{at + 1} AS MATERIALIZED (SELECT p.tree, 2 * p.node + CASE WHEN fs[k] < cut THEN 0 ELSE 1 END AS node, fs FROM p{at} p JOIN n{at} n ON n.tree = p.tree AND n.node = p.node WHERE inside)")
    path = "CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
    out += [
        "nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{at}" for at in range(levels + 1)) + ")",
        f"w0 AS (SELECT symbol, window_start, fs, tree, 1::BIGINT AS node FROM x, range({trees}) t(tree))",
    ]
    for at in range(levels):
        out.append(f"w{at + 1} AS (SELECT symbol, window_start, fs, w.tree, CASE WHEN inside THEN 2 * w.node + CASE WHEN fs[k] < cut THEN 0 ELSE 1 END ELSE w.node END AS node FROM w{at} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)")
    out += [
        f"depths AS (SELECT symbol, window_start, sum(floor(log2(w.node)) + {path.format(n='n.n')}) AS depth FROM w{levels} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY ALL)",
        f"scores AS MATERIALIZED (SELECT symbol, window_start, round(pow(2.0, -(depth / {trees}) / (SELECT avg({path.format(n='n')}) FROM sizes)), 9) AS isolation FROM depths)",
        "cut AS (SELECT isolation AS c FROM scores QUALIFY row_number() OVER (ORDER BY isolation) = (SELECT ceil(0.99 * count(*)) FROM scores))",
        "found AS (SELECT x.*, isolation > c AS is_anomaly, c - isolation AS anomaly_score, greatest(0, least(1, isolation - c)) AS severity FROM x JOIN scores USING (symbol, window_start), cut)",
    ]
    return f"WITH {BARS}, {ANOMALY}, " + ", ".join(out)


SQL["ml7_ml8_anomalies"] = view(
    isolation() + ", y AS (SELECT *, coalesce(volume_zscore, 0) AS v, coalesce(price_change_pct_zscore, 0) AS p, coalesce(trade_size_uniformity, 0) AS u FROM found) SELECT symbol, window_start, is_anomaly, severity, anomaly_score, CASE WHEN NOT is_anomaly THEN NULL WHEN v > 3 AND abs(p) < 1 THEN 'wash_trade' WHEN p > 3 AND v > 2 THEN 'pump' WHEN p < -3 AND v > 2 THEN 'dump' WHEN u > 0.9 THEN 'wash_trade' WHEN buy_sell_imbalance > 0.8 THEN 'price_manipulation' WHEN v > 4 THEN 'volume_spike' ELSE 'unknown' END AS anomaly_type FROM y",
    "symbol is_anomaly anomaly_type", "severity anomaly_score", "window_start",
)
SQL["a10_anomaly_summary"] = view(isolation() + " SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS flagged, avg(is_anomaly::INT) AS rate, avg(anomaly_score) AS mean_score, stddev_samp(anomaly_score) AS std_score FROM found", "n flagged", "rate mean_score std_score")

SQL["st5_files_per_trigger"] = """WITH t AS (SELECT epoch_us(CAST(ts AS TIMESTAMP)) AS u FROM events), e AS (SELECT min(u) AS lo, max(u) AS hi FROM t)
 SELECT least(floor((u - lo) * 4 / greatest(hi - lo, 1)::DOUBLE), 3)::INT AS batch, count(*) AS n FROM t, e GROUP BY ALL"""
SQL["s9_in_batches"] = "SELECT event_type AS key, count(*) AS n, TRUE AS bounded FROM events GROUP BY ALL"
