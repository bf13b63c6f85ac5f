"""Pipelines on Structured Streaming. Sources and sinks come in from outside, so files stand in for brokers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tickloom.operators.bars import TIME, bar_features
from tickloom.operators.features import ema, numbered
from tickloom.operators.parse import bronze_trades, silver_trades
from tickloom.operators.sentiment import scored_articles
from tickloom.operators.stored import latest_batch, merge_batch, touched_rows, upsert_batch
from tickloom.session import exists, removed


def bars_stream(trades: DataFrame, duration: str, watermark: str = "10 seconds") -> DataFrame:
    """Bars as they close: a window comes out when the watermark has passed its end."""
    return bar_features(trades, duration, watermark)


def first_seen(df: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Each key once, as first seen; the state is forgotten after `within`."""
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def trades_pipeline(messages: DataFrame) -> DataFrame:
    """Broker messages to silver trades."""
    return silver_trades(bronze_trades(messages))


def news_pipeline(news: DataFrame) -> DataFrame:
    """Silver news to a row per article and symbol."""
    return scored_articles(news)


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Runs `run(rows, number)` for every micro-batch; without a trigger for all that is there, then it ends. A batch can come
    again after a failure, with the same number and rows. Its rows are written once, under `path`, and removed when it is done:
    stateful operators before it run once a batch, and a lost executor costs a read."""

    def batch(df: DataFrame, n: int) -> None:
        spark, own = df.sparkSession, f"{path}/_arrived/{n}"
        df.write.mode("overwrite").parquet(own)
        run(spark.read.schema(df.schema).parquet(own), n)
        removed(spark, own)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 16, trigger: str | None = None) -> StreamingQuery:
    """Merges every micro-batch into a stored table (`stored.read_stored`), where the latest row of each key stays. A batch
    reads and replaces the buckets of its keys only."""
    return each_batch(stream, lambda df, n: latest_batch(df, path, n, keys, order, buckets) and None, path, checkpoint, trigger)


def upserts(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 16, trigger: str | None = None) -> StreamingQuery:
    """Upserts every micro-batch into a stored table; keys must be unique in a batch."""
    return each_batch(stream, lambda df, n: upsert_batch(df, path, n, keys, buckets) and None, path, checkpoint, trigger)


def series_stream(bars: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, back: int, ahead: int = 0, buckets: int = 16, trigger: str | None = None) -> StreamingQuery:
    """Runs a series operator (`features`, `signals`) on a stream of bars, with the results of the batch.

    `operator` is the batch operator itself; it must keep its rows' columns and look no further than `back` rows before and
    `ahead` rows after a row. The last rows of each symbol, as many as that, are kept in a stored table under `path`; a
    micro-batch sees them before its own bars. A row comes out once, when `ahead` rows after it are there; what a
    micro-batch gives is one folder of `path`/rows, which a batch that comes again leaves as it is. Bars of a symbol must
    come in the order of time, as `bars_stream` gives them."""
    rows, tail = f"{path}/rows", f"{path}/tail"

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        own = f"{rows}/batch_id={n}"
        if not exists(spark, f"{own}/_SUCCESS"):
            before = touched_rows(df, tail, ["symbol"], buckets)
            both = df.withColumn("_old", F.lit(None).cast("long"))
            if before is not None:  # places from the end tell which of them came out already
                now = df.select(F.col("symbol").alias("_s")).distinct()
                before = before.join(now, F.col("symbol").eqNullSafe(F.col("_s")), "left_semi")
                both = numbered(before).withColumn("_old", F.col("_n") - 1 - F.col("_at")).drop("_at", "_n").unionByName(both)
            both = numbered(both)
            due = (F.col("_n") - 1 - F.col("_at") >= ahead) & (F.col("_old").isNull() | (F.col("_old") < ahead))
            operator(both.withColumn("_due", due).drop("_at", "_n", "_old")).filter("_due").drop("_due").write.mode("overwrite").parquet(own)
        merge_batch(df, tail, n, ["symbol"], lambda old, new: last_rows(new if old is None else old.unionByName(new), back + ahead), buckets)

    return each_batch(bars, batch, path, checkpoint, trigger)


def ema_stream(bars: DataFrame, period: int, path: str, checkpoint: str, column: str = "close", buckets: int = 16, trigger: str | None = None) -> StreamingQuery:
    """The exponential average of a stream of bars, with the results of the batch: each symbol goes on from its last average,
    which a stored table under `path` keeps. Rows come out as in `series_stream`."""
    rows, tail = f"{path}/rows", f"{path}/tail"

    def batch(df: DataFrame, n: int) -> None:
        spark, own = df.sparkSession, f"{rows}/batch_id={n}"
        if df.isEmpty():
            return
        if not exists(spark, f"{own}/_SUCCESS"):
            ema(df, period, column, before=touched_rows(df, tail, ["symbol"], buckets)).write.mode("overwrite").parquet(own)
        latest_batch(spark.read.parquet(own), tail, n, ["symbol"], "window_start", buckets)

    return each_batch(bars, batch, path, checkpoint, trigger)


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """The last `n` bars of each symbol."""
    return numbered(bars).filter(F.col("_n") - F.col("_at") <= n).drop("_at", "_n")


def series_rows(spark: SparkSession, path: str) -> DataFrame:
    """What `series_stream` has given so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch_id")


def seen_once(stream: DataFrame, groups: list[str], key: str, most: int) -> DataFrame:
    """Rows whose `key` (a long that grows with time) a group has not seen lately. At the end of a micro-batch a group forgets all
    but its `most` largest keys, so state is bounded by count, not by time. Of rows with one key in a micro-batch the first in
    the order of all columns comes out; rows without a key always do. A group with most of the rows is cut by adding a
    hash of the key to `groups`, and `most` is then a share's."""
    names, schema = stream.columns, stream.schema

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = np.array(state.get[0] if state.exists else [], np.int64)
        df = pd.concat(list(parts), ignore_index=True)
        nameless = df[df[key].isna()]
        df = df[df[key].notna()]
        df = df.sort_values(names, kind="stable").drop_duplicates(key) if len(df) else df
        df = df[~df[key].astype("int64").isin(seen)]
        kept = np.sort(np.concatenate([seen, df[key].to_numpy(np.int64)]))[-most:] if most else seen[:0]
        state.update((kept.tolist(),))
        yield pd.concat([df, nameless], ignore_index=True) if len(nameless) else df

    return stream.groupBy(*groups).applyInPandasWithState(run, schema, "seen array<long>", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table in memory: for looks and tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def closed(bars: DataFrame, trades: DataFrame, watermark: str) -> DataFrame:
    """Bars whose windows the watermark has passed: those that a stream of these trades has emitted."""
    edge = trades.agg((F.max(TIME) - F.expr(f"INTERVAL {watermark}")).alias("edge"))
    return bars.join(F.broadcast(edge), F.col("window_end") <= F.col("edge")).drop("edge")
