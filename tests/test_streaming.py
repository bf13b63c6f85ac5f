"""What a stream gives equals what a batch gives."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import features as W
from tickloom.operators import stored
from tickloom.sources import files
from tickloom.streaming import pipelines as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, trade_id long, price double, quantity double, is_buyer_maker boolean, trade_timestamp timestamp"


def trades(spark, path):
    rows = [(f"s{k % 3}", k, 10.0 + k % 7, 1.0, k % 2 == 0, T0 + dt.timedelta(seconds=17 * k)) for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(4, "trade_timestamp").sortWithinPartitions("trade_timestamp").write.parquet(path)
    return spark.read.parquet(path)


def test_bars(spark, tmp_path):
    batch = trades(spark, f"{tmp_path}/t")
    stream = files.table_stream(spark, f"{tmp_path}/t", batch.schema, files_per_trigger=4)
    got = S.drained(S.bars_stream(stream, "5 minutes", "10 seconds"), "bars_out")
    want = S.closed(B.bar_features(batch, "5 minutes"), batch, "10 seconds")
    key = lambda r: (r.symbol, r.window_start)
    assert want.count() > 20 and sorted(got.collect(), key=key) == sorted(want.select(got.columns).collect(), key=key)


def test_first_and_latest(spark, tmp_path):
    batch = trades(spark, f"{tmp_path}/t")
    again = batch.withColumn("price", F.col("price") + 1)
    again.write.mode("append").parquet(f"{tmp_path}/t")
    stream = files.table_stream(spark, f"{tmp_path}/t", batch.schema)
    first = S.drained(S.first_seen(stream, ["symbol", "trade_id"], "trade_timestamp", "2 hours"), "first_out")
    assert first.count() == 300
    S.keep_latest(stream.withColumn("order", F.col("price")), f"{tmp_path}/latest", ["symbol", "trade_id"], "order", f"{tmp_path}/c", buckets=3).awaitTermination()
    got = stored.read_stored(spark, f"{tmp_path}/latest")
    assert sorted((r.trade_id, r.price) for r in got.collect()) == sorted((r.trade_id, r.price) for r in again.collect())


def parts_of(spark, tmp_path, n=3):
    """The trades in stretches of time, and a function that lets the next of them arrive."""
    batch = trades(spark, f"{tmp_path}/all")
    edges = [T0 + dt.timedelta(seconds=17 * 300 * k // n) for k in range(n + 1)]
    arrive = lambda k: batch.filter((F.col("trade_timestamp") >= F.lit(edges[k])) & (F.col("trade_timestamp") < F.lit(edges[k + 1]))).write.parquet(f"{tmp_path}/in/{k}")
    return batch, arrive


def series_run(spark, tmp_path, batch, operator, back, ahead=0):
    stream = files.table_stream(spark, f"{tmp_path}/in/*", batch.schema)
    S.series_stream(S.bars_stream(stream, "5 minutes"), operator, f"{tmp_path}/out", f"{tmp_path}/progress", back, ahead, buckets=2).awaitTermination()


def same_rows(got, want):
    key = lambda r: (r[0], r[2])
    plain = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(got.columns).collect()], key=key)
    assert got.columns[:3] == ["symbol", "interval", "window_start"] and plain(got) == plain(want)


@pytest.mark.parametrize("name,operator,back,ahead", [("both", lambda b: W.labelled(W.rsi(b, 2), ahead=1), 2, 1)])
def test_series_with_restarts(spark, tmp_path, name, operator, back, ahead):
    batch, arrive = parts_of(spark, tmp_path)
    for k in range(3):
        arrive(k)
        series_run(spark, tmp_path, batch, operator, back, ahead)
    series_run(spark, tmp_path, batch, operator, back, ahead)  # nothing new, nothing twice
    bars = S.closed(B.bar_features(batch, "5 minutes"), batch, "10 seconds")
    assert bars.count() > 20
    same_rows(S.series_rows(spark, f"{tmp_path}/out"), operator(bars))


@pytest.mark.parametrize("broken", ["merge_batch", "numbered", "removed"])
def test_series_after_a_failure(spark, tmp_path, monkeypatch, broken):
    """A batch that dies before its rows, between rows and tail, or behind both, and comes again."""
    batch, arrive = parts_of(spark, tmp_path, 2)
    arrive(0)
    series_run(spark, tmp_path, batch, lambda b: W.rsi(b, 3), 3)
    arrive(1)

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, broken, fail)
        with pytest.raises(StreamingQueryException):
            series_run(spark, tmp_path, batch, lambda b: W.rsi(b, 3), 3)
    series_run(spark, tmp_path, batch, lambda b: W.rsi(b, 3), 3)
    same_rows(S.series_rows(spark, f"{tmp_path}/out"), W.rsi(S.closed(B.bar_features(batch, "5 minutes"), batch, "10 seconds"), 3))


def test_ema_goes_on_from_batch_to_batch(spark, tmp_path, monkeypatch):
    batch, arrive = parts_of(spark, tmp_path)
    run = lambda: S.ema_stream(S.bars_stream(files.table_stream(spark, f"{tmp_path}/in/*", batch.schema), "5 minutes"), 4, f"{tmp_path}/out", f"{tmp_path}/c", buckets=2).awaitTermination()
    arrive(0)
    run()
    arrive(1)
    with monkeypatch.context() as m:  # dies behind its rows, and comes again
        m.setattr(S, "latest_batch", lambda *a: 1 / 0)
        with pytest.raises(StreamingQueryException):
            run()
    arrive(2)
    run()
    plain = lambda df: sorted((r.symbol, r.window_start, round(r.ema, 9)) for r in df.collect())
    assert plain(S.series_rows(spark, f"{tmp_path}/out")) == plain(W.ema(S.closed(B.bar_features(batch, "5 minutes"), batch, "10 seconds"), 4))


def test_seen_once_is_bounded_by_count(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([("a", k, f"x{k}") for k in ids] + [("b", 1, "y"), ("b", None, "z")], "symbol string, id long, text string")
    run = lambda: files.stream_to_table(S.seen_once(files.table_stream(spark, f"{tmp_path}/in/*", rows([]).schema), ["symbol"], "id", 3), f"{tmp_path}/out", f"{tmp_path}/c", ["symbol"]).awaitTermination()
    for k, ids in enumerate([[1, 2, 2, 3, 4, 5], [5, 4, 3, 2, 1, 6], [6, 2]]):
        rows(ids).write.parquet(f"{tmp_path}/in/{k}")
        run()
    got = sorted((r.symbol, r.id is None, r.id or 0) for r in files.read_table(spark, f"{tmp_path}/out").collect())
    # the group keeps 3, 4, 5, then 4, 5, 6
    assert got == sorted([("a", False, k) for k in [1, 2, 3, 4, 5, 1, 2, 6, 2]] + [("b", False, 1)] + [("b", True, 0)] * 3)


def test_sink_recovers_from_its_checkpoint(spark, tmp_path):
    batch = trades(spark, f"{tmp_path}/t")
    run = lambda: files.stream_to_table(files.table_stream(spark, f"{tmp_path}/t", batch.schema), f"{tmp_path}/out", f"{tmp_path}/c", ["symbol"]).awaitTermination()
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300
    batch.limit(5).write.mode("append").parquet(f"{tmp_path}/t")
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 305


def test_messages_to_silver(spark, tmp_path):
    from tickloom.sources.adapters import raw_trades

    events = spark.range(50).select(F.col("id").alias("event_id"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("click").alias("event_type"), (F.col("id") + 0.5).alias("value"), F.lit('{"k": 1}').alias("props"))
    raw_trades(events).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    got = S.drained(S.trades_pipeline(files.table_stream(spark, f"{tmp_path}/m", m.schema)), "silver_out")
    columns = ["trade_id", "symbol", "price", "quantity", "side", "trade_timestamp"]
    assert sorted(got.select(columns).collect()) == sorted(S.trades_pipeline(m).select(columns).collect()) and got.count() == 50
