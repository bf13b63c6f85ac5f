"""A session with the settings that the operators rely on: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "tickloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def layer_path(root: str, layer: str, table: str) -> str:
    """Where a table of a layer (bronze, silver, gold, features) lies."""
    return f"{root.rstrip('/')}/{layer}/{table}"


def checkpoint_path(root: str, pipeline: str) -> str:
    return f"{root.rstrip('/')}/checkpoints/{pipeline}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path for a table that driver and executors share, in the folder that `spark.checkpoint.dir` names.

    Only a session on one machine may name none; it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names; it may be a pattern."""
    store, there = _place(spark, path)
    return bool(store.globStatus(there))


def removed(spark: SparkSession, path: str) -> None:
    store, there = _place(spark, path)
    store.delete(there, True)
