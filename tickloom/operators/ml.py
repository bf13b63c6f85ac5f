"""Direction models and anomaly detection on Spark ML and Spark jobs."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.features import numbered
from tickloom.operators.rules import anomaly_type
from tickloom.session import scratch_path

# The columns of the models.
MARKET = ["open", "high", "low", "close", "volume", "vwap", "volatility", "buy_sell_ratio"]
SERIES = ["price_change_pct", "price_change_pct_lag_1", "price_change_pct_lag_3", "price_change_pct_lag_5", "volume_change_pct", "volatility_change", "ema_crossover", "rolling_mean_price", "rolling_std_price", "momentum", "vwap_deviation"]
SENTIMENT = ["sentiment_score", "sentiment_confidence", "sentiment_momentum", "article_count"]
ANOMALY = ["volume_zscore", "trade_count_zscore", "price_change_pct_zscore", "high_low_range_zscore", "buy_sell_imbalance", "trade_size_uniformity", "trade_frequency_spike"]


def chronological(df: DataFrame, part: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Earlier rows of each symbol train, later ones test: no future leaks into the past."""
    ranked = numbered(df).withColumn("_early", F.col("_at") < part * (F.col("_n") - 1)).drop("_at", "_n")
    return ranked.filter("_early").drop("_early"), ranked.filter("NOT _early").drop("_early")


def direction_pipeline(labels: list[str], features: list[str], label: str = "direction", classifier=None, seed: int = 7) -> Pipeline:
    """Index, assemble, scale, classify, name. Three classes need a forest or one boosted model a class."""
    classifier = classifier or forest(seed=seed)
    classifier = classifier.copy().setFeaturesCol("features").setLabelCol("label_index")
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            classifier,
            IndexToString(inputCol="prediction", outputCol="predicted", labels=labels),
        ]
    )


def labels_of(df: DataFrame, label: str = "direction") -> list[str]:
    """The classes, in the order of the indexer; a handful by nature."""
    return sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)


def forest(trees: int = 30, depth: int = 6, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def boosted(iterations: int = 50, depth: int = 5, step: float = 0.1, seed: int = 7) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=step, seed=seed))


def price_model() -> OneVsRest:
    """The single price model's boosted trees: 200 of depth 6, a class each."""
    return boosted(iterations=200, depth=6)


def train(df: DataFrame, features: list[str], label: str = "direction", classifier=None) -> PipelineModel:
    return direction_pipeline(labels_of(df, label), features, label, classifier).fit(df)


def in_folds(df: DataFrame, folds: int) -> DataFrame:
    """`fold`: stretches of time of each symbol, not random rows."""
    return numbered(df).withColumn("fold", F.least(F.floor(F.col("_at") * folds / F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(folds - 1)).cast("int")).drop("_at", "_n")


def tuned(df: DataFrame, features: list[str], depths: list[int], trees: list[int] = (), iterations: list[int] = (), steps: list[float] = (), folds: int = 3, label: str = "direction", parallelism: int = 2) -> CrossValidatorModel:
    """Grid search by F1 over stretches of time: a forest's depths and trees, or with `iterations` and `steps` the depths,
    iterations and steps of boosted models, one a class."""
    classifier = boosted() if iterations or steps else forest()
    pipeline = direction_pipeline(labels_of(df, label), features, label, classifier)
    model, grid = pipeline.getStages()[3], ParamGridBuilder()
    if iterations or steps:
        # a class's model cannot be reached by the grid from outside: each point is a whole model
        made = [GBTClassifier(maxDepth=d, maxIter=n, stepSize=x, seed=7) for d in depths for n in iterations or [50] for x in steps or [0.1]]
        grid = grid.addGrid(model.classifier, made)
    else:
        grid = grid.addGrid(model.maxDepth, depths).addGrid(model.numTrees, trees or [30])
    scorer = MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid.build(), evaluator=scorer, numFolds=folds, foldCol="fold", parallelism=parallelism, seed=7).fit(in_folds(df, folds))


def first_trees(model: OneVsRestModel, iterations: int) -> OneVsRestModel:
    """The boosted models as they were after so many iterations: each of their first trees, with its weight."""

    def cut(one: GBTClassificationModel) -> GBTClassificationModel:
        gateway, java = SparkSession.active().sparkContext._gateway, one._java_obj
        trees, weights = list(java.trees())[:iterations], list(java.treeWeights())[:iterations]
        kind = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        some, own = gateway.new_array(kind, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
        for k, (t, w) in enumerate(zip(trees, weights, strict=True)):
            some[k], own[k] = t, w
        made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{one.uid}-{iterations}", some, own)
        return one._copyValues(GBTClassificationModel(made))

    return model._copyValues(OneVsRestModel([cut(m) for m in model.models]))


def staged_f1(df: DataFrame, features: list[str], depths: list[int], iterations: list[int], steps: list[float], folds: int = 3, label: str = "direction", seed: int = 7) -> DataFrame:
    """(depth, step, iterations, f1): the grid of boosted models, one a class, by weighted F1 over stretches of time, best first.

    A model of few iterations is the beginning of one of many, so each depth and step is fitted once a fold, for the most
    iterations, and its predictions at every stage are scored in one pass. The rows are read by every tree, so they should
    come from a table."""
    labels, rows = labels_of(df, label), in_folds(df, folds)
    found: list[tuple[int, float, int, float]] = []
    for depth in depths:
        for step in steps:
            totals = dict.fromkeys(iterations, 0.0)
            for k in range(folds):
                model = direction_pipeline(labels, features, label, boosted(max(iterations), depth, step, seed)).fit(rows.filter(F.col("fold") != k))
                held = rows.filter(F.col("fold") == k)
                for stage in model.stages[:3]:
                    held = stage.transform(held)
                for n in iterations:
                    held = first_trees(model.stages[3], n).setPredictionCol(f"at_{n}").transform(held).drop("rawPrediction")
                stages = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"at_{n}").alias("prediction")) for n in iterations]))
                scored = held.select("label_index", stages.alias("s")).select("label_index", "s.*")
                cells = scored.groupBy("n", "label_index", "prediction").agg(F.count(F.lit(1)).alias("rows")).collect()  # classes by classes
                for n in iterations:
                    totals[n] += weighted_f1({(r.label_index, r.prediction): r.rows for r in cells if r.n == n}) / folds
            found += [(depth, step, n, f1) for n, f1 in totals.items()]
    return df.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[3], r[:3])), "depth int, step double, iterations int, f1 double")


def weighted_f1(cells: dict[tuple[float, float], int]) -> float:
    """F1 of each class, weighted by its rows, out of counts by (class, predicted class)."""
    total, out = sum(cells.values()), 0.0
    for c in {label for label, _ in cells}:
        support, named = sum(n for (y, _), n in cells.items() if y == c), sum(n for (_, p), n in cells.items() if p == c)
        out += support * 2 * cells.get((c, c), 0) / (support + named)
    return out / total if total else 0.0


def predictions(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("probabilities", vector_to_array("probability")) if "probability" in out.columns else out


def metrics(predicted: DataFrame, label: str = "label_index", prediction: str = "prediction") -> DataFrame:
    """Accuracy, weighted and macro precision, recall and F1, and rows, from one pass over the predictions."""
    cells = predicted.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit("l").alias("s")), F.struct(F.col("p").alias("c"), F.lit("p").alias("s")))).alias("x"), F.col("l"), F.col("p"), "n")
    per = sides.groupBy("x.c").agg(
        F.sum(F.when((F.col("x.s") == "l") & (F.col("l") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.s") == "l", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.s") == "p", F.col("n")).otherwise(0)).alias("named"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumns({"precision": zero(F.col("tp"), F.col("named")), "recall": zero(F.col("tp"), F.col("support")), "f1": zero(2 * F.col("tp"), F.col("named") + F.col("support"))})
    weighted = lambda c: zero(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return per.agg(
        zero(F.sum("tp"), F.sum("support")).alias("accuracy"), *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias("rows"),
    )


def ranked(features: DataFrame) -> DataFrame:
    """`rank` of each feature by falling importance; a row a feature, so one window holds them all."""
    return features.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def importances(names: list[str], values, spark) -> DataFrame:
    """A model's feature importances with their rank."""
    return ranked(spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double"))


def permutation_importances(model: PipelineModel, df: DataFrame, features: list[str], label: str = "direction", seed: int = 7, rows: int = 10_000) -> DataFrame:
    """(feature, importance, rank): the accuracy that a fitted model loses on `df` when one feature's values change rows.

    Rows are dealt by a seeded hash into buckets of about `rows`; within one, each feature takes the value of the next row in an
    order of its own, so one shuffle serves all features. The row as it is and its variants, one a feature, are scored together."""
    complete = df.dropna(subset=[*features, label])
    buckets = max(1, math.ceil(complete.count() / rows))
    dealt = complete.withColumn("_h", F.xxhash64(*complete.columns, F.lit(seed))).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    order = lambda k: Window.partitionBy("_bucket").orderBy(F.xxhash64("_h", F.lit(k)), "_h")
    moved = dealt.withColumns({f"_p{k}": F.coalesce(F.lead(f).over(order(k)), F.first(f).over(order(k).rowsBetween(Window.unboundedPreceding, 0))) for k, f in enumerate(features)})
    as_is = [F.col(f).cast("double").alias(f) for f in features]
    variants = [F.struct(F.lit(-1).alias("_v"), *as_is)] + [F.struct(F.lit(k).alias("_v"), *as_is[:k], F.col(f"_p{k}").cast("double").alias(f), *as_is[k + 1 :]) for k, f in enumerate(features)]
    scored = model.transform(moved.select(label, F.explode(F.array(*variants)).alias("r")).select(label, "r.*"))
    accuracy = scored.groupBy("_v").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"))
    names = F.array(*[F.lit(f) for f in features])
    whole = F.max(F.when(F.col("_v") == -1, F.col("a"))).over(Window.partitionBy())  # a row a feature and one more
    return ranked(accuracy.withColumn("importance", whole - F.col("a")).filter("_v >= 0").select(F.get(names, F.col("_v")).alias("feature"), "importance"))


# --- isolation forest -------------------------------------------------------------------------------


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def unit(*parts) -> float:
    """A number from 0 to 1 out of a hash of the parts; the same in any engine that knows MD5."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def grow(x: np.ndarray, tree: int, seed: int) -> list[list[float]]:
    """One tree as rows (feature or -1, cut, left, right, points): random cuts until points are alone or deep enough. What a
    node draws depends on the seed, the tree and the node's number (children of k: 2 k and 2 k + 1) alone."""
    limit, made = math.ceil(math.log2(max(len(x), 2))), []

    def add(points: np.ndarray, node: int, depth: int) -> int:
        at = len(made)
        made.append([-1.0, 0.0, 0.0, 0.0, float(len(points))])
        varying = np.flatnonzero(points.max(axis=0) > points.min(axis=0)) if len(points) else []
        if depth >= limit or len(points) <= 1 or not len(varying):
            return at
        f = int(varying[int(unit(seed, tree, node, "feature") * len(varying))])
        low, high = points[:, f].min(), points[:, f].max()
        cut = low + unit(seed, tree, node, "cut") * (high - low)
        left = points[:, f] < cut
        made[at][:4] = [float(f), float(cut), float(add(points[left], 2 * node, depth + 1)), float(add(points[~left], 2 * node + 1, depth + 1))]
        return at

    add(x, 1, 0)
    return made


def isolation_forest(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42, keys: list[Column] | None = None) -> list[tuple[int, list[list[float]]]]:
    """Trees of the forest. Each is grown by a task on its own bounded sample; the driver receives only finished trees.

    A row is drawn for a tree by a number of its `keys` (its features, if none are named): one hash a row gives two numbers,
    and these the number for each tree. So samples depend on the rows alone, not on how they are dealt."""
    named = keys or [F.col(f).cast("double") for f in features]
    x = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in named])).alias("_m")).dropna()
    n = x.count()
    share, span = min(1.0, 2.0 * sample / max(n, 1)), 1 << 31
    half = lambda k: F.conv(F.substring("_m", k, 8), 16, 10).cast("long") % span
    own = lambda tree: ((F.col("_a") + tree * F.col("_b")) % span) / float(span)
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), own(t).alias("u"))), lambda d: d["u"] < share)
    drawn = x.withColumns({"_a": half(1), "_b": half(9)}).withColumn("d", F.explode(draws)).select(*features, "d.tree", "d.u")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", *features]).head(sample)
        k = int(pdf["tree"].iloc[0])
        return pd.DataFrame({"tree": [k], "n": [len(pdf)], "nodes": [grow(pdf[features].to_numpy(float), k, seed)]})

    grown = drawn.groupBy("tree").applyInPandas(one, "tree int, n int, nodes array<array<double>>").collect()
    return [(r.n, r.nodes) for r in sorted(grown, key=lambda r: r.tree)]


def isolation_scores(df: DataFrame, features: list[str], forest: list[tuple[int, list[list[float]]]], out: str = "isolation") -> DataFrame:
    """Adds 2 ** (-mean path / expected path), to 9 digits: near 1 for outliers. Rows with a NULL feature get NULL."""
    trees = [(average_path(n), np.array(nodes)) for n, nodes in forest]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        depths = np.zeros(len(x))
        expected = sum(float(c) for c, _ in trees) / max(len(trees), 1)
        for _, t in trees:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            while True:
                node = t[at]
                inner = node[:, 0] >= 0
                if not inner.any():
                    break
                f = np.maximum(node[:, 0].astype(int), 0)
                low = x[np.arange(len(x)), f] < node[:, 1]
                at = np.where(inner, np.where(low, node[:, 2], node[:, 3]).astype(int), at)
                depth += inner
            depths += depth + average_path(t[at][:, 4])
        s = 2.0 ** (-(depths / max(len(trees), 1)) / max(expected, 1e-9))
        return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, np.round(s, 9))).astype("Float64")

    return df.withColumn(out, score(*[F.col(f).cast("double") for f in features]))


def detected(df: DataFrame, features: list[str] = ANOMALY, contamination: float = 0.01, trees: int = 100, sample: int = 256, keys: list[Column] | None = None) -> DataFrame:
    """Anomaly flag, score (negative: anomalous), severity and type of every row, on standardised features (to 6 digits).

    The rows are read five times (statistics, count, sample, cut, result), so they are written once before. The cut
    is a sketch's percentile, with a rank error of 1e-5."""
    path = scratch_path(df.sparkSession, "anomaly-features")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    stats = df.agg(*[F.struct(F.avg(f), F.stddev_pop(f)).alias(f) for f in features]).first()
    scaled = {f"_s_{f}": F.round((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.lit(stats[f][0] or 0.0)) / F.lit(stats[f][1] or 1.0), 6) for f in features}
    x = df.withColumns(scaled)
    scored = isolation_scores(x, list(scaled), isolation_forest(x, list(scaled), trees, sample, keys=keys))
    cut = scored.agg(F.percentile_approx("isolation", 1 - contamination, 100_000)).first()[0]
    flagged = scored.withColumns({"anomaly_score": F.lit(cut) - F.col("isolation"), "is_anomaly": F.col("isolation") > F.lit(cut)})
    kind, said = anomaly_type(F.col("is_anomaly"))
    return flagged.withColumns({"severity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("anomaly_score"))), "anomaly_type": kind, "description": said}).drop(*scaled)


def run_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("flagged"), F.avg(F.col("is_anomaly").cast("double")).alias("rate"), F.avg("anomaly_score").alias("mean_score"), F.stddev("anomaly_score").alias("std_score"))
