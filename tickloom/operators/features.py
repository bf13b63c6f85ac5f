"""Features over the bars of a symbol, all in one window order: symbol, window_start.

The operators cut long series into blocks (`in_blocks`), so a symbol with most of the bars is shared by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numbers import change_pct, clip, direction, ratio
from tickloom.session import scratch_path


def series():
    return Window.partitionBy("symbol").orderBy("window_start")


def rows(back: int):
    """The current row and `back` rows before it."""
    return series().rowsBetween(-back, 0)


def numbered(bars: DataFrame, chunk: str = "day") -> DataFrame:
    """`bars` with `_at`, the place of a row in its symbol from 0 on, and `_n`, the rows of its symbol.

    Rows are numbered by counts per symbol and chunk of time, never by one sort of a whole series: the only window over
    a whole symbol runs over its counts, a row a chunk. NULL symbols and times are a series and a chunk of their own."""
    part = bars.withColumn("_chunk", F.date_trunc(chunk, "window_start"))
    counts = part.groupBy(F.col("symbol").alias("_s"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_s")
    before = counts.withColumns({"_before": F.sum("_rows").over(whole.orderBy("_c")) - F.col("_rows"), "_n": F.sum("_rows").over(whole)}).drop("_rows")
    at = F.col("_before") + F.row_number().over(Window.partitionBy("symbol", "_chunk").orderBy("window_start")) - 1
    placed = part.join(before, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    return placed.withColumn("_at", at).drop("_chunk", "_before", "_s", "_c")


#: Rows of a block of a series.
BLOCK = 100_000


def in_blocks(bars: DataFrame, operator: Callable[[DataFrame], DataFrame], back: int = 120, ahead: int = 0, size: int | None = None, chunk: str = "day") -> DataFrame:
    """`operator(bars)`, with long series cut into blocks of `size` rows, so that a symbol with most of the rows is
    shared by many tasks. Each block also sees `back` rows before it and `ahead` rows after it, which is
    exact for operators whose frames reach no further."""
    size = size or BLOCK
    if back > size or ahead > size:
        raise ValueError("a block must be longer than its surroundings")
    own, place = F.floor(F.col("_at") / size), F.col("_at") % size
    copies = F.array_compact(
        F.array(
            F.struct(own.alias("b"), F.lit(True).alias("own")),
            F.when((place >= size - back) & (F.col("_at") - place + size < F.col("_n")), F.struct((own + 1).alias("b"), F.lit(False).alias("own"))),
            F.when((place < ahead) & (own > 0), F.struct((own - 1).alias("b"), F.lit(False).alias("own"))),
        )
    )
    dealt = numbered(bars, chunk).withColumn("_to", F.explode(copies)).withColumn("symbol", F.struct(F.col("symbol").alias("s"), F.col("_to.b").alias("b")))
    out = operator(dealt.withColumn("_own", F.col("_to.own")).drop("_at", "_n", "_to"))
    return out.filter("_own").drop("_own").withColumn("symbol", F.col("symbol.s"))


def lagged(column: str, *steps: int, name: str = "{c}_lag_{k}") -> dict[str, Column]:
    return {name.format(c=column, k=k): F.lag(column, k).over(series()) for k in steps}


def change_from_previous(column: str) -> Column:
    return change_pct(F.col(column), F.lag(column).over(series()))


def momentum(column: str = "close", back: int = 5) -> Column:
    return change_pct(F.col(column), F.lag(column, back).over(series()))


def vwap_deviation() -> Column:
    return change_pct(F.col("close"), F.col("vwap"))


def z_score(column: str | Column, back: int = 20) -> Column:
    """Against the rolling mean and deviation of back + 1 rows; 0 where nothing varies."""
    x = F.col(column) if isinstance(column, str) else column
    deviation = F.stddev(x).over(rows(back))
    return F.when(deviation > 0, (x - F.avg(x).over(rows(back))) / deviation).otherwise(F.lit(0.0))


def time_series(bars: DataFrame, fill: bool = True) -> DataFrame:
    """Lags, changes, averages, momentum. `ema_*` are simple means of 5 and 20 closes, by name only exponential."""
    short, long = F.avg("close").over(rows(4)), F.avg("close").over(rows(19))
    columns = {
        **lagged("price_change_pct", 1, 3, 5),
        "volume_change_pct": change_from_previous("volume"),
        "volatility_change": change_from_previous("volatility"),
        "ema_short": short,
        "ema_long": long,
        "ema_crossover": F.when(short > long, F.lit(1.0)).otherwise(F.lit(-1.0)),
        "rolling_mean_price": F.avg("close").over(rows(9)),
        "rolling_std_price": F.stddev("close").over(rows(9)),
        "momentum": momentum(),
        "vwap_deviation": vwap_deviation(),
    }
    out = in_blocks(bars, lambda b: b.withColumns(columns), back=19)
    return out.na.fill(0.0) if fill else out


def labelled(bars: DataFrame, ahead: int = 5, threshold: float = 0.1) -> DataFrame:
    """Direction of the close `ahead` rows on; rows without that future go."""
    future = F.lead("close", ahead).over(series())
    return in_blocks(bars, lambda b: b.withColumn("_future", future), back=0, ahead=ahead).filter("_future IS NOT NULL").withColumn("direction", direction(change_pct(F.col("_future"), F.col("close")), threshold)).drop("_future")


def simple_changes(bars: DataFrame) -> DataFrame:
    """Features of the single-node price model: lags 1 to 3, relative and absolute changes (NULL at the start)."""
    before = F.lag("volume").over(series())
    columns = {
        "vwap_deviation": F.try_divide((F.col("close") - F.col("vwap")) * 100, F.col("vwap")),
        **lagged("price_change_pct", 1, 2, 3, name="{c}_lag{k}"),
        "volume_change_pct": F.try_divide((F.col("volume") - before) * 100, before),
        "volatility_change": F.col("volatility") - F.lag("volatility").over(series()),
    }
    return in_blocks(bars, lambda b: b.withColumns(columns), back=3)


def normalised(bars: DataFrame, columns: list[str], back: int = 20) -> DataFrame:
    """Adds the rolling z-score of each column as `<column>_normalised`."""
    return in_blocks(bars, lambda b: b.withColumns({f"{c}_normalised": z_score(c, back) for c in columns}), back=back)


def rsi(prices: DataFrame, period: int = 14, column: str = "close") -> DataFrame:
    """Relative strength over the last `period` changes: 50 with fewer prices than that or no movement, 100 if all
    rise, 0 if all fall."""
    step = F.col(column) - F.lag(column).over(series())
    frame = rows(period - 1)
    gain, loss, n = F.avg(F.greatest("_d", F.lit(0.0))).over(frame), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame), F.count("_d").over(frame)
    value = F.when(n < period, F.lit(50.0)).when(gain + loss == 0, F.lit(50.0)).otherwise(100 * F.try_divide(gain, gain + loss))
    return in_blocks(prices, lambda b: b.withColumn("_d", step).withColumn("rsi", value).drop("_d"), back=period)


def bollinger(prices: DataFrame, period: int = 20, width: float = 2.0, column: str = "close") -> DataFrame:
    """Bands around the rolling mean by the population deviation, and their relative width."""
    middle, deviation = F.avg(column).over(rows(period - 1)), F.stddev_pop(column).over(rows(period - 1))
    columns = {"bb_middle": middle, "bb_upper": middle + width * deviation, "bb_lower": middle - width * deviation, "bb_bandwidth": ratio(2 * width * deviation, middle)}
    return in_blocks(prices, lambda b: b.withColumns(columns), back=period - 1)


def ema(prices: DataFrame, period: int, column: str = "close", chunk: str = "day", before: DataFrame | None = None) -> DataFrame:
    """(symbol, window_start, ema): true exponential average, alpha = 2 / (period + 1), from the first value on, or from a
    symbol's average in `before` (symbol, ema) on, where it has one.

    A step is the map e -> keep e + alpha x with keep = 1 - alpha. A series is cut into blocks of so many rows that keep to
    the power of a block is 1e-100, some 115 a period: inside one, e is a running sum of alpha x / keep^k, scaled back by keep^k,
    and what a block starts with is the sum of the block before and, for what little is left of them, of the three before
    that. So every row costs the same however long a series is, and a symbol with most of the rows is shared by many tasks."""
    alpha = 2.0 / (period + 1)
    values = prices.filter(F.col(column).isNotNull()).select("symbol", "window_start", F.col(column).cast("double").alias("_x"))
    if alpha >= 1:
        return values.withColumnRenamed("_x", "ema")
    size = math.ceil(100 * math.log(10) / -math.log1p(-alpha))
    keep = F.lit(1 - alpha)
    power = lambda k: F.pow(keep, k.cast("double"))
    placed = numbered(values, chunk).withColumns({"_b": F.floor(F.col("_at") / size), "_k": F.col("_at") % size})
    inside = Window.partitionBy("symbol", "_b").orderBy("_k")
    summed = placed.withColumn("_e", power(F.col("_k")) * F.sum(F.lit(alpha) * F.col("_x") / power(F.col("_k"))).over(inside))
    # one row a block: its own sum, and the first value of the series
    blocks = summed.groupBy(F.col("symbol").alias("_s"), F.col("_b").alias("_c")).agg(F.max_by("_e", "_k").alias("_sum"), F.min_by("_x", "_k").alias("_first"))
    order = Window.partitionBy("_s").orderBy("_c")
    whole = power(F.lit(size))
    carried = F.lit(0.0)
    for back in (3, 2, 1):
        own = F.lag("_sum", back).over(order)
        carried = F.when(F.col("_c") >= back, own + whole * carried).otherwise(F.col("_start"))
    start = F.first("_first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if before is not None:
        blocks = blocks.join(before.select(F.col("symbol").alias("_q"), F.col("ema").alias("_seed")), F.col("_s").eqNullSafe(F.col("_q")), "left")
        start = F.coalesce("_seed", start)
    starts = blocks.withColumn("_start", start).withColumn("_before", carried).select("_s", "_c", "_before")
    joined = summed.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    return joined.select("symbol", "window_start", (power(F.col("_k") + 1) * F.col("_before") + F.col("_e")).alias("ema"))


def anomaly_features(bars: DataFrame, window: int = 60) -> DataFrame:
    """Rolling z-scores, imbalance, uniformity of trade sizes, spikes of trade frequency."""
    frame = rows(window - 1)
    z = {f"{c}_zscore": (F.col(c) - F.avg(c).over(frame)) / (F.stddev(c).over(frame) + F.lit(1e-8)) for c in ("volume", "trade_count", "price_change_pct", "high_low_range")}
    size = F.col("volume") / (F.col("trade_count") + 1)
    columns = {
        **z,
        "buy_sell_imbalance": F.abs(F.col("buy_sell_ratio") - 0.5) * 2,
        "trade_size_uniformity": 1 - clip(F.stddev("volume").over(frame) / (size + F.lit(1e-8)), 0.0, 1.0),
        "trade_frequency_spike": clip(F.col("trade_count") / (F.avg("trade_count").over(rows(2 * window - 1)) + 1), 0.0, 10.0),
    }
    return in_blocks(bars, lambda b: b.withColumns(columns), back=2 * window - 1)


#: Values of an interval that are sorted in one place.
FEW = 10_000


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], few: int | None = None) -> dict[tuple[str, int], float]:
    """The values at these ranks (from 0) among each column's non-null values, exactly, without a sort or a buffer of them.

    A rank lies in an open interval, at first all values. A sketch of the values inside brackets it, one pass counts what is
    below, at and between the two bounds, and so moves the rank to a bound, which is the answer, or to a smaller interval,
    of some thousandth of the values; once `few` are left they are sorted. All ranks of all columns share the passes, and
    the driver holds a few numbers a rank."""
    few, error = few or FEW, 1e-3
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple] = {(c, k): (None, None, k) for c, ks in ranks.items() for k in ks}

    def inside(column: str, low, high) -> Column:
        x = F.col(column).cast("double")
        fits = x.isNotNull()
        fits = fits if low is None else fits & (x > F.lit(low))
        return fits if high is None else fits & (x < F.lit(high))

    while open_:
        targets = list(open_.items())
        sizes = df.agg(*[F.count_if(inside(c, low, high)).alias(f"n{i}") for i, ((c, _), (low, high, _)) in enumerate(targets)]).first()
        for (key, _), n in zip(targets, sizes, strict=True):
            if not n:
                raise ValueError(f"no value of rank {key[1]} in {key[0]}")
        small = [i for i, n in enumerate(sizes) if n <= few]
        large = [i for i, n in enumerate(sizes) if n > few]
        own = lambda i: (targets[i][0][0], *targets[i][1])  # noqa: E731  column, low, high, rank
        value = lambda i: F.when(inside(*own(i)[:3]), F.col(own(i)[0]).cast("double"))
        if small:
            lists = df.agg(*[F.sort_array(F.collect_list(value(i))).alias(f"v{i}") for i in small])
            picked = lists.select(*[F.get(f"v{i}", F.lit(own(i)[3])).alias(f"v{i}") for i in small]).first()
            found |= {targets[i][0]: v for i, v in zip(small, picked, strict=True)}
        left = {}
        if large:
            shares = [[max(0.0, own(i)[3] / sizes[i] - error), min(1.0, (own(i)[3] + 1) / sizes[i] + error)] for i in large]
            sketched = df.agg(*[F.percentile_approx(value(i), s, 10_000).alias(f"b{i}") for i, s in zip(large, shares, strict=True)]).first()
            parts = []
            for i, (a, b) in zip(large, sketched, strict=True):
                x = value(i)
                parts += [F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if((x == b) & (x > a))]
            counts = df.agg(*[p.alias(f"c{k}") for k, p in enumerate(parts)]).first()
            for at, (i, (a, b)) in enumerate(zip(large, sketched, strict=True)):
                _, low, high, k = own(i)
                below, first, between, last = counts[4 * at : 4 * at + 4]
                if k < below:
                    left[targets[i][0]] = (low, a, k)
                elif k < below + first:
                    found[targets[i][0]] = a
                elif k < below + first + between:
                    left[targets[i][0]] = (a, b, k - below - first)
                elif k < below + first + between + last:
                    found[targets[i][0]] = b
                else:
                    left[targets[i][0]] = (b, high, k - below - first - between - last)
        open_ = left
    return found


def profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Mean, deviation, 95th and 99th percentile of each column, a row a column.

    Exact percentiles come from `order_statistics`, which reads the columns several times, so they are written once before;
    `exact=False` takes sketches (rank error 1e-4) in one pass."""
    moments = lambda c: [F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev(c).alias("std")]
    if not exact:
        at = lambda c, q: F.percentile_approx(c, q, 10000).cast("double")
        stats = [F.struct(*moments(c), at(c, 0.95).alias("q95"), at(c, 0.99).alias("q99")) for c in columns]
        return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "profile")
    df.select(*columns).write.parquet(path)
    df = spark.read.parquet(path)
    rows = df.agg(*[F.struct(*moments(c), F.count(c).alias("n")).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    place = lambda n, q: q * (n - 1)
    ranks = {c: sorted({r for q in (0.95, 0.99) for r in (math.floor(place(s.n, q)), math.ceil(place(s.n, q)))}) for c, s in zip(columns, rows, strict=True) if s.n}
    found = order_statistics(df, ranks)

    def percentile(c: str, n: int, q: float) -> float | None:
        if not n:
            return None
        low, high = math.floor(place(n, q)), math.ceil(place(n, q))
        return found[c, low] if low == high else (high - place(n, q)) * found[c, low] + (place(n, q) - low) * found[c, high]

    made = [(s.feature, s["mean"], s["std"], percentile(c, s.n, 0.95), percentile(c, s.n, 0.99)) for c, s in zip(columns, rows, strict=True)]
    return spark.createDataFrame(made, "feature string, mean double, std double, q95 double, q99 double")
