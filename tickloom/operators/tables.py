"""Jobs on whole tables: upsert, latest-wins merge, versions, history, compaction.

Tables are frames; writing goes to a new path (or by partition), so a job that fails leaves the old
table as it was. A versioned table is its change log: keys, columns, `version`, `committed_at`, `op`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.parse import distinct_trades, silver_trades


def require_unique(source: DataFrame, keys: list[str]) -> None:
    if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"the source has rows with equal {keys}")


def upserted(target: DataFrame | None, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """The target with its rows replaced by the source's of the same keys, and the source's new ones."""
    if check:
        require_unique(source, keys)
    return source if target is None else target.join(source, keys, "left_anti").unionByName(source)


def upsert_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """(updated, inserted) of an upsert."""
    marked = source.join(target.select(*keys, F.lit(True).alias("_old")), keys, "left")
    return marked.agg(F.count_if(F.col("_old").isNotNull()).alias("updated"), F.count_if(F.col("_old").isNull()).alias("inserted"))


def merged_latest(target: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` of each key; on ties the target's stays."""
    both = target.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc(), "_new"))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")


def as_of(log: DataFrame, keys: list[str], version: int | None = None, timestamp: str | None = None) -> DataFrame:
    """The table at a version or a time: the last change of each key by then, if it is no delete."""
    if version is not None:
        log = log.filter(F.col("version") <= version)
    if timestamp is not None:
        log = log.filter(F.col("committed_at") <= F.lit(timestamp).cast("timestamp"))
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), "version").alias("r")).select("r.*")
    return last.filter(F.col("op") != "delete").drop("op", "version", "committed_at")


def compared(log: DataFrame, keys: list[str], a: int, b: int) -> DataFrame:
    """Row counts of two versions, net rows added, and rows that only one of them has."""
    one, two = as_of(log, keys, a), as_of(log, keys, b)
    marked = one.withColumn("_in", F.lit("a")).unionByName(two.withColumn("_in", F.lit("b")))
    per_row = marked.groupBy(*one.columns).agg(F.count_if(F.col("_in") == "a").alias("a"), F.count_if(F.col("_in") == "b").alias("b"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return per_row.agg(
        total("a").alias("rows_a"), total("b").alias("rows_b"), total(F.col("b") - F.col("a")).alias("rows_added"),
        total(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_in_b"), total(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_in_a"), F.lit(one.schema == two.schema).alias("same_schema"),
    )


def commit_history(log: DataFrame, n: int = 10) -> DataFrame:
    made = log.groupBy("version").agg(F.max("committed_at").alias("committed_at"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col("op") == "delete").alias("deletes"))
    return made.orderBy(F.col("version").desc()).limit(n)


def table_details(df: DataFrame) -> DataFrame:
    """Files, bytes and rows of a table that was read from files."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("rows").alias("rows"))


def as_number(df: DataFrame, column: str) -> Column:
    """A double that keeps the column's order, roughly for text: its first seven bytes."""
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def with_z_value(df: DataFrame, columns: list[str], bits: int = 8) -> DataFrame:
    """Adds `_z`, the place of a row on a space-filling curve through several columns: each value becomes one of 2^bits ranges of
    about equal rows, and the bits of the ranges' numbers are interleaved. NULL lies in the first range. Bounds come from one
    pass of sketches; the driver holds 2^bits - 1 of them a column."""
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("bits of all columns must fit a long")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(as_number(df, c), shares, 10_000).alias(f"b{k}") for k, c in enumerate(columns)]).first()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])

    def place(column: str, edges: list[float] | None) -> Column:
        """How many bounds are below the value, by binary search."""
        x, e = as_number(df, column), F.array(*[F.lit(float(v)) for v in edges or [0.0] * len(shares)])
        return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(e, low + step - 1) < x, low + step).otherwise(low))

    placed = df.withColumns({f"_z{k}": place(c, bounds[k]) for k, c in enumerate(columns)})
    value = F.lit(0).cast("long")
    for k in range(len(columns)):
        for bit in range(bits):
            own = F.shiftright(f"_z{k}", bit).bitwiseAND(F.lit(1)).cast("long")
            value = value + F.shiftleft(own, bit * len(columns) + len(columns) - 1 - k)
    return placed.withColumn("_z", value).drop(*[f"_z{k}" for k in range(len(columns))])


def compact(spark: SparkSession, path: str, to: str, cluster_by: list[str] | None = None, files: int | None = None, interleave: bool = False) -> DataFrame:
    """Rewrites a table in fewer files to a new path, sorted and ranged by the clustering columns.

    Without `interleave` a file holds a range of the first column; with it files are cells of all of them, so that a filter on
    any of the columns leaves most files out."""
    df = spark.read.parquet(path)
    if cluster_by:
        by = ["_z"] if interleave else cluster_by
        df = with_z_value(df, cluster_by) if interleave else df
        df = (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by)
        df = df.drop("_z") if interleave else df
    elif files:
        df = df.repartition(files)
    else:
        df = df.hint("rebalance")
    df.write.parquet(to)
    return spark.read.parquet(to)


def files_matching(df: DataFrame, column: str, cells: DataFrame) -> DataFrame:
    """For each row (low, high) of `cells`: the files whose range of `column` meets it, as a reader with file statistics would
    open them. A row a file is compared with the few cells."""
    ranges = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    met = ranges.join(F.broadcast(cells), (F.col("_least") < F.col("high")) & (F.col("_most") >= F.col("low")))
    return cells.join(met.groupBy("low", "high").agg(F.count(F.lit(1)).alias("files")), ["low", "high"], "left").na.fill(0, ["files"])


def reprocessed(target: DataFrame, bronze: DataFrame) -> DataFrame:
    """A batch of bronze trades through silver into the target, latest ingestion first."""
    return merged_latest(target, distinct_trades(silver_trades(bronze)), ["symbol", "trade_id"], "ingested_at")
