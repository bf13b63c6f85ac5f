"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: With it Spark drops the shuffle files of a query when the query ends: a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: How tables of a step are stored. A writer, and later a reader, holds one row group of this size at a time.
STORED = {"compression": "zstd", "parquet.block.size": str(32 << 20)}


def trimmed() -> None:
    """Gives a Python worker's free memory back to the system: workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a session on one machine (tests) may name none; a temporary one is made then. A cluster's executors would
    write to their own disks, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Paths that this process has named in shared folders, and not removed.
MADE: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    MADE.append(f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def removed(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that `scratch` named, and that no frame still to be run reads."""
    for path in made:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        MADE.remove(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read back.

    Cuts the lineage (a lost executor costs a re-read, not a re-computation) and gives
    Spark the true size of the table, so that it picks broadcast or sort-merge joins by size. While it
    writes, the session's setting for shuffle files is changed; a query that runs beside it only drops its own sooner.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**STORED).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id: a 64-bit hash of the text (null: empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
