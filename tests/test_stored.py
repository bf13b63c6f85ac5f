"""Stored tables: batches touch their buckets only, come again without effect, and survive failures."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import stored
from tickloom.operators import tables as K


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, part string, v long")


def names(spark, path):
    return {(r.bucket, r.file) for r in stored.files_of(spark, path).collect()}


def rows(spark, path):
    return sorted((r.k, r.v) for r in stored.read_stored(spark, path).collect())


def test_upserts_touch_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert stored.read_stored(spark, path) is None
    stored.upsert_batch(frame(spark, [(k, "abc"[k % 3], 0) for k in range(30)]), path, 0, ["k"], by="part")
    before = names(spark, path)
    change = frame(spark, [(k, "b", 1) for k in (1, 4, 100)])
    assert stored.upsert_batch(change, path, 1, ["k"], by="part")
    after = names(spark, path)
    assert {x for x in before if x[0] != "b"} == {x for x in after if x[0] != "b"} and not {x for x in before if x[0] == "b"} & after
    assert not stored.upsert_batch(change, path, 1, ["k"], by="part") and names(spark, path) == after
    assert rows(spark, path) == sorted([(k, 1 if k in (1, 4) else 0) for k in range(30)] + [(100, 1)])


def test_latest_keeps_the_newest_and_ties_keep_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    stored.latest_batch(frame(spark, [(1, "old", 5), (2, "old", 5), (3, "old", 5), (3, "older", 4)]), path, 0, ["k"], "v", buckets=3)
    stored.latest_batch(frame(spark, [(1, "new", 4), (2, "new", 6), (3, "new", 5), (4, "new", 1), (4, "newer", 2)]), path, 1, ["k"], "v", buckets=3)
    got = {r.k: (r.part, r.v) for r in stored.read_stored(spark, path).collect()}
    assert got == {1: ("old", 5), 2: ("new", 6), 3: ("old", 5), 4: ("newer", 2)}


@pytest.mark.parametrize("broken", ["put_in_place", "removed"])
def test_a_batch_that_dies_comes_again(spark, tmp_path, monkeypatch, broken):
    path = f"{tmp_path}/t"
    stored.upsert_batch(frame(spark, [(k, "x", 0) for k in range(9)]), path, 0, ["k"], buckets=4)

    def fail(*args):
        raise RuntimeError("lost")

    change = frame(spark, [(2, "x", 7), (50, "x", 7)])
    with monkeypatch.context() as m:
        m.setattr(stored, broken, fail)
        with pytest.raises(RuntimeError):
            stored.upsert_batch(change, path, 1, ["k"], buckets=4)
    stored.upsert_batch(change, path, 1, ["k"], buckets=4)
    assert rows(spark, path) == sorted([(k, 7 if k == 2 else 0) for k in range(9)] + [(50, 7)])
    assert not stored.upsert_batch(change, path, 1, ["k"], buckets=4)


def test_null_and_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    stored.latest_batch(frame(spark, [(1, None, 1), (2, "a", 1), (None, None, 3)]), path, 0, ["k"], "v", by="part")
    assert not stored.latest_batch(frame(spark, []), path, 1, ["k"], "v", by="part")
    stored.latest_batch(frame(spark, [(1, None, 2), (None, None, 1)]), path, 2, ["k"], "v", by="part")
    assert sorted((r.k or 0, r.v) for r in stored.read_stored(spark, path).collect()) == [(0, 3), (1, 2), (2, 1)]


def test_curve_interleaves_ranges(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = {(r.x, r.y): r._z for r in K.with_z_value(df, ["x", "y"], bits=3).collect()}
    spread = lambda v: sum((v >> b & 1) << 2 * b for b in range(3))
    assert got == {(x, y): 2 * spread(x) + spread(y) for x in range(8) for y in range(8)}


def test_curve_takes_text_times_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (None, 2), ("zebra", 3), ("zoo", 4)], "s string, n int").withColumns({"d": F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce("n", F.lit(0))), "t": F.timestamp_seconds("n")})
    got = {r.s: r._z for r in K.with_z_value(df, ["s"], bits=4).collect()}
    assert got[None] <= got["a"] < got["b"] < got["zebra"] < got["zoo"]
    assert K.with_z_value(df, ["s", "n", "d", "t"], bits=4).filter("_z IS NULL").count() == 0
    assert K.with_z_value(df.limit(0), ["n"]).count() == 0
    with pytest.raises(ValueError):
        K.with_z_value(df, ["s", "n"], bits=32)


def test_interleaved_files_serve_both_columns(spark, tmp_path):
    spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y")).repartition(8).write.parquet(f"{tmp_path}/many")
    cells = spark.range(0, 64, 4).select(F.col("id").alias("low"), (F.col("id") + 4).alias("high"))
    sums = {}
    for name, interleave in (("sorted", False), ("curve", True)):
        df = K.compact(spark, f"{tmp_path}/many", f"{tmp_path}/{name}", ["x", "y"], 16, interleave)
        assert sorted(tuple(r) for r in df.collect()) == [(x, y) for x in range(64) for y in range(64)]
        sums[name] = [sum(r.files for r in K.files_matching(df, c, cells).collect()) for c in ("x", "y")]
    assert sums["curve"][1] * 2 < sums["sorted"][1] and max(sums["curve"]) <= 16 * 6
