"""Tables that grow by batches: each batch reads and replaces only the buckets that it touches.

A stored table is a folder of Parquet files by bucket. A bucket is a hash of the key columns, or a column that the keys
determine (`by`). A batch is merged in three steps: the touched buckets, with the batch merged in, are written beside the
table; then they replace the old ones, bucket by bucket; then the copy goes. A run that dies between is made good by
running the batch again: a whole copy is put in place again, an unfinished one is made anew. Rows carry the number
of the last batch that wrote their bucket, so a batch that comes again changes no file. One writer a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickloom.operators.tables import merged_latest, upserted
from tickloom.session import exists, removed

# The columns that a stored table has besides its own.
BUCKET, BATCH = "merge_bucket", "merge_batch"

Combine = Callable[[DataFrame | None, DataFrame], DataFrame]


def whole(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder by bucket; buckets are text, whatever they look like."""
    fields = [StructField(f.name, StringType()) if f.name == BUCKET else f for f in spark.read.parquet(path).schema]
    return spark.read.schema(StructType(fields)).parquet(path)


def read_stored(spark: SparkSession, path: str, marks: bool = False) -> DataFrame | None:
    """The table, or None if no batch has been merged yet; `marks` keeps bucket and batch."""
    if not exists(spark, f"{path}/{BUCKET}=*"):
        return None
    df = whole(spark, path)
    return df if marks else df.drop(BUCKET, BATCH)


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def touched_rows(source: DataFrame, path: str, keys: list[str], buckets: int = 16) -> DataFrame | None:
    """The table's rows in the buckets that the source's keys fall in; the others are not read."""
    old = read_stored(source.sparkSession, path, marks=True)
    if old is None:
        return None
    touched = [r[0] for r in source.select(bucket(keys, buckets)).distinct().collect()]
    return old.filter(within(touched)).drop(BUCKET, BATCH)


def merge_batch(source: DataFrame, path: str, batch: int, keys: list[str], combine: Combine, buckets: int = 16, by: str | None = None) -> bool:
    """Merges `source` into the table as batch number `batch`; False if it had been merged before.

    `combine(old, new)` gives the new rows of the touched buckets; `old` is None for a new table. `keys` and `by` must send
    rows that meet in `combine` to one bucket. The source is read twice: its buckets first, then its rows."""
    spark = source.sparkSession
    staged = f"{path}/_staged/{batch}"
    place = F.col(by).cast("string") if by else bucket(keys, buckets)
    if not exists(spark, f"{staged}/_SUCCESS"):
        new = source.withColumn(BUCKET, place)
        old = read_stored(spark, path, marks=True)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # as many as there are buckets
        if old is not None:
            had = old.filter(within(touched)).groupBy(BUCKET).agg(F.max(BATCH).alias("last")).filter(F.col("last") >= batch)
            done = {r[0] for r in had.collect()}
            touched = [b for b in touched if b not in done]
        if not touched:
            return False
        new = new.filter(within(touched)).drop(BUCKET)
        merged = combine(None if old is None else old.filter(within(touched)).drop(BUCKET, BATCH), new)
        merged = merged.withColumns({BUCKET: place, BATCH: F.lit(batch)})
        merged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(staged)
    put_in_place(spark, staged, path)
    removed(spark, staged)
    return True


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    whole(spark, staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def within(touched: list) -> Column:
    """Rows of these buckets; NULL is one too. The filter prunes folders."""
    found = F.col(BUCKET).isin([b for b in touched if b is not None])
    return found | F.col(BUCKET).isNull() if None in touched else found


def upsert_batch(source: DataFrame, path: str, batch: int, keys: list[str], buckets: int = 16, by: str | None = None) -> bool:
    """The batch's rows replace those of the same keys; keys must be unique in a batch."""
    return merge_batch(source, path, batch, keys, lambda old, new: upserted(old, new, keys), buckets, by)


def latest_batch(source: DataFrame, path: str, batch: int, keys: list[str], order: str, buckets: int = 16, by: str | None = None) -> bool:
    """The row with the largest `order` of each key stays; on ties the table's."""

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        newest = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
        return newest if old is None else merged_latest(old, newest, keys, order)

    return merge_batch(source, path, batch, keys, combine, buckets, by)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, bucket) of the table as it is."""
    return whole(spark, path).select(F.col("_metadata.file_name").alias("file"), F.col(BUCKET).alias("bucket")).distinct()
