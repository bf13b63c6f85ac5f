"""Sentiment per article and symbol, and its windows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text as T
from tickloom.functions.numbers import ratio


def scored_articles(news: DataFrame, score: Column | None = None, keep_without_symbol: bool = False, lexicon: T.Lexicon = T.ARTICLE_WORDS) -> DataFrame:
    """A row per article and symbol. Articles without a symbol go, unless they are kept with a NULL one."""
    s = score if score is not None else T.lexicon_sentiment(F.concat_ws(" ", "title", "content"), lexicon)
    each = F.explode_outer if keep_without_symbol else F.explode
    rows = news.withColumn("_s", s).withColumn("symbol", each("mentioned_symbols"))
    return rows.select("article_id", "source", "title", "symbol", F.col("_s.label").alias("sentiment_label"), F.col("_s.score").alias("sentiment_score"), F.col("_s.confidence").alias("sentiment_confidence"), "published_timestamp", "word_count", "content_hash")


def model_scored(news: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], key: str = "article_id", text: str = "content", shortest: int = 10, longest: int | None = 512) -> DataFrame:
    """(key, label, score, confidence) by a model that is loaded once a worker and scores batches of texts.

    Texts under `shortest` characters are neutral; the model sees the first `longest`, as many as it reads, or all of a text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            said = pdf[text].fillna("")
            long = said.str.len() >= shortest
            label, confidence = pd.Series("neutral", pdf.index), pd.Series(0.5, pdf.index)
            if long.any():
                found = model(said[long].str.slice(0, longest).tolist())
                label[long], confidence[long] = [x for x, _ in found], [float(c) for _, c in found]
            sign = label.map({"positive": 1.0, "negative": -1.0}).fillna(0.0)
            yield pd.DataFrame({key: pdf[key], "label": label, "score": sign * confidence, "confidence": confidence})

    return news.select(key, text).mapInPandas(run, f"{key} {dict(news.dtypes)[key]}, label string, score double, confidence double")


def word_counts(texts: list[str], width: int) -> np.ndarray:
    """Rows of log counts of words, hashed into `width` columns, each row of length one."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        places = [zlib.crc32(w.encode()) % width for w in re.findall(r"\w+", text.lower())]
        np.add.at(row, places, 1.0)
    out = np.log1p(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def text_model(labelled: DataFrame, text: str, positive: Column, sample: int = 2000, width: int = 4096, rounds: int = 300, seed: int = 7) -> Callable[[], Callable[[list[str]], list[tuple[str, float]]]]:
    """A small model for `model_scored`: logistic regression on hashed words, both classes with equal weight.

    It is fitted on at most `sample` labelled rows, those with the least seeded hashes; these come to the driver, and so
    does nothing else. Rows without a text or a label teach nothing; with one class only, every text is of that class."""
    rows = labelled.select(F.col(text).alias("t"), positive.cast("double").alias("y")).dropna()
    taken = rows.orderBy(F.xxhash64("t", F.lit(seed)), "t", "y").limit(sample).collect()
    x, y = word_counts([r.t for r in taken], width), np.array([r.y for r in taken])
    weight = np.where(y > 0, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1))
    w, b, speed = np.zeros(width), 0.0, np.zeros(width + 1)
    for _ in range(rounds if taken else 0):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        speed = 0.9 * speed + np.append(x.T @ error + 1e-4 * w, error.sum())
        w, b = w - 2.0 * speed[:-1], b - 2.0 * speed[-1]

    def load() -> Callable[[list[str]], list[tuple[str, float]]]:
        def score(texts: list[str]) -> list[tuple[str, float]]:
            out: list[tuple[str, float]] = []
            for low in range(0, len(texts), 256):
                p = 1 / (1 + np.exp(-(word_counts(texts[low : low + 256], width) @ w + b)))
                out += [("positive", float(v)) if v >= 0.5 else ("negative", float(1 - v)) for v in p]
            return out

        return score

    return load


def dominant(positive: Column, negative: Column, neutral: Column) -> Column:
    """Positive if no other has more; negative if it has more than both; else neutral."""
    return F.when((positive >= negative) & (positive >= neutral), "positive").when((negative > positive) & (negative > neutral), "negative").otherwise("neutral")


def sentiment_windows(scored: DataFrame, duration: str = "15 minutes") -> DataFrame:
    count = lambda label: F.count_if(F.col("sentiment_label") == label)
    made = scored.groupBy("symbol", F.window("published_timestamp", duration).alias("w")).agg(
        F.avg("sentiment_score").alias("mean_score"), ratio(F.sum(F.col("sentiment_score") * F.col("sentiment_confidence")), F.sum("sentiment_confidence"), None).alias("weighted_score"),
        F.avg("sentiment_confidence").alias("sentiment_confidence"), F.count(F.lit(1)).alias("article_count"), count("positive").alias("positive_count"), count("negative").alias("negative_count"), count("neutral").alias("neutral_count"),
    )
    label = dominant(F.col("positive_count"), F.col("negative_count"), F.col("neutral_count"))
    return made.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean_score", "weighted_score", "sentiment_confidence", "article_count", "positive_count", "negative_count", "neutral_count", label.alias("dominant_label"))


def for_fusion(windows: DataFrame) -> DataFrame:
    """The columns that bars are joined with."""
    return windows.select("symbol", "window_start", F.col("weighted_score").alias("sentiment_score"), "sentiment_confidence", "article_count")


def mean_sentiment(scored: DataFrame) -> DataFrame:
    """Means and counts by symbol and window start."""
    return scored.groupBy("symbol", "window_start").agg(F.avg("sentiment_score").alias("sentiment_score"), F.avg("sentiment_confidence").alias("sentiment_confidence"), F.count(F.lit(1)).alias("article_count"))


def with_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Bars with their window's sentiment; without one neutral: 0, confidence 0.5, no article."""
    return bars.join(sentiment, ["symbol", "window_start"], "left").na.fill({"sentiment_score": 0.0, "sentiment_confidence": 0.5, "article_count": 0})


def label_counts(df: DataFrame, label: str = "sentiment") -> DataFrame:
    return df.agg(*[F.count_if(F.col(label) == x).alias(f"{x}_count") for x in ("positive", "negative", "neutral")])
