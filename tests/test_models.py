import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ml as M

T0 = dt.datetime(2024, 1, 1)


def frame(spark, n=240):
    r = np.random.default_rng(1)
    rows = []
    for k in range(n):
        x = float(r.normal())
        rows.append((f"s{k % 2}", T0 + dt.timedelta(hours=k // 2), x, float(r.normal()), "UP" if x > 0.5 else "DOWN" if x < -0.5 else "NEUTRAL"))
    return spark.createDataFrame(rows, "symbol string, window_start timestamp, x double, noise double, direction string")


def test_three_classes_keep_their_names(spark, tmp_path):
    early, late = M.chronological(frame(spark))
    assert early.agg(F.max("window_start")).first()[0] < late.agg(F.min("window_start")).first()[0]
    model = M.train(early, ["x", "noise"])
    out = M.predictions(model, late)
    assert out.filter(F.col("predicted") == F.col("direction")).count() / out.count() > 0.8
    m = M.metrics(out).first()
    assert m.accuracy > 0.8 and m.rows == late.count() and 0 < m.macro_f1 <= 1
    model.write().overwrite().save(f"{tmp_path}/m")
    again = type(model).load(f"{tmp_path}/m")
    assert again.transform(late).select("predicted").collect() == out.select("predicted").collect()


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 3 + [(0.0, 1.0)] + [(1.0, 1.0)] * 2 + [(1.0, 0.0)] * 2, "label_index double, prediction double")
    m = M.metrics(df).first()
    assert m.accuracy == pytest.approx(5 / 8) and m.macro_precision == pytest.approx((3 / 5 + 2 / 3) / 2) and m.weighted_recall == pytest.approx(5 / 8)


def test_boosted_and_tuned(spark):
    df = frame(spark, 160)
    out = M.train(df, ["x"], classifier=M.boosted(iterations=5, depth=2)).transform(df)
    assert out.filter(F.col("predicted") == F.col("direction")).count() / out.count() > 0.9
    assert len(M.tuned(df, ["x"], [2], [5, 10]).avgMetrics) == 2
    grid = M.tuned(df, ["x"], [1], iterations=[1], steps=[0.1, 0.3], folds=2)
    assert len(grid.avgMetrics) == 2 and max(grid.avgMetrics) > 0.5
    best = grid.bestModel.transform(df)
    assert best.filter(F.col("predicted") == F.col("direction")).count() / best.count() > 0.5


def test_isolation_forest_ranks_outliers_first(spark):
    r = np.random.default_rng(42)
    x = r.normal(size=(1000, 3))
    x[10:16, 0], x[50:56, 1], x[100:106, 2] = 9.0, -8.0, 10.0
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "id long, a double, b double, c double")
    forest = M.isolation_forest(df, ["a", "b", "c"], trees=60)
    assert len(forest) == 60 and all(n <= 256 for n, _ in forest)
    top = [q.id for q in M.isolation_scores(df, ["a", "b", "c"], forest).orderBy(F.col("isolation").desc()).limit(18).collect()]
    assert set(top) == {*range(10, 16), *range(50, 56), *range(100, 106)}
    again = M.isolation_forest(df.repartition(7), ["a", "b", "c"], trees=60)
    assert again == forest


def test_importances(spark):
    got = M.importances(["a", "b"], [0.2, 0.8], spark).orderBy("rank").collect()
    assert [(x.feature, x.rank) for x in got] == [("b", 1), ("a", 2)]


def test_permuted_features_lose_what_they_are_worth(spark):
    rows = spark.range(600).select(F.when(F.col("id") * 7919 % 1000 > 500, "up").otherwise("down").alias("direction"), (F.col("id") * 7919 % 1000).cast("double").alias("tells"), (F.col("id") % 13).cast("double").alias("idle"), F.lit(1.0).alias("same"))
    features = ["tells", "idle", "same"]
    model = M.train(rows, features, classifier=M.forest(5, 3))
    got = {r.feature: r for r in M.permutation_importances(model, rows, features, rows=100).collect()}
    assert got["tells"].importance > 0.3 and got["tells"].rank == 1
    assert abs(got["idle"].importance) < 0.05 and got["same"].importance == 0
    again = {r.feature: r.importance for r in M.permutation_importances(model, rows.repartition(5), features, rows=100).collect()}
    assert again == {k: r.importance for k, r in got.items()}


def test_text_model_learns_words_and_equals_a_direct_score(spark):
    import numpy as np

    from tickloom.operators import sentiment as S

    rows = [(k, " ".join(["good fine" if k % 2 else "bad awful", f"word{k % 7}", "and so on"]), k % 2) for k in range(200)]
    df = spark.createDataFrame([*rows, (300, None, 1), (301, "short", None)], "article_id long, content string, y int")
    load = S.text_model(df, "content", F.col("y") == 1, sample=100)
    got = {r.article_id: r for r in S.model_scored(df, load, longest=None).collect()}
    assert all(got[k].label == ("positive" if y else "negative") for k, _, y in rows)
    assert got[300].label == got[301].label == "neutral"
    for k, text, _ in rows[:9]:
        (label, confidence), = load()([text])
        assert (got[k].label, got[k].confidence) == (label, confidence) and np.sign(got[k].score) == (1 if label == "positive" else -1)
    empty = S.text_model(df.limit(0), "content", F.col("y") == 1)
    assert empty()(["some text"]) == [("positive", 0.5)]


@pytest.mark.parametrize("few", [1, 3, 40, 10_000])
def test_order_statistics_equal_a_sort(spark, few):
    from tickloom.operators import features as W

    values = [float(k * 7919 % 997) for k in range(3000)] + [5.0] * 4000 + [1e300, -1e300, 0.1]
    df = spark.createDataFrame([(v, None if k % 3 else v) for k, v in enumerate(values)], "x double, y double")
    xs, ys = sorted(values), sorted(v for k, v in enumerate(values) if k % 3 == 0)
    ranks = {"x": [0, 1, 2500, 6650, 6652, len(xs) - 1], "y": [0, 17, len(ys) - 1]}
    got = W.order_statistics(df, ranks, few)
    assert got == {(c, k): v[k] for c, v in (("x", xs), ("y", ys)) for k in ranks[c]}


def test_stages_of_one_fit_equal_fits_of_fewer_iterations(spark):
    df = frame(spark, 90)
    features = ["x", "noise"]
    long, short = (M.train(df, features, classifier=M.boosted(n, 2)) for n in (4, 2))
    rows = df
    for stage in long.stages[:3]:
        rows = stage.transform(rows)
    pick = lambda model: [r.prediction for r in model.transform(rows).orderBy("symbol", "window_start").collect()]
    assert pick(M.first_trees(long.stages[3], 2)) == pick(short.stages[3]) and pick(M.first_trees(long.stages[3], 9)) == pick(long.stages[3])
    grid = M.staged_f1(df, features, [2], [1, 3], [0.1], folds=2).collect()
    assert sorted(r.iterations for r in grid) == [1, 3] and all(0 < r.f1 <= 1 for r in grid) and grid[0].f1 == max(r.f1 for r in grid)


def test_weighted_f1_equals_the_metrics_of_spark(spark):
    pairs = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (2.0, 2.0), (1.0, 3.0)]
    cells = {p: pairs.count(p) for p in pairs}
    df = spark.createDataFrame(pairs, "label_index double, prediction double")
    assert M.weighted_f1(cells) == pytest.approx(M.metrics(df).first().weighted_f1)
