"""Reading and writing tables, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickloom.schemas import TRADE_EVENT
from tickloom.sources.feeds import TRADE_FIELDS, json_rows


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 100_000, **options: str) -> DataFrame:
    """A topic as a stream: from the latest offset, and going on when data is lost. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    settings = {"startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": str(offsets_per_trigger), **options}
    return reader.options(**settings).load()


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """A growing table as a stream, at most so many files a trigger."""
    reader = spark.readStream.format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "delta":
        return reader.option("ignoreChanges", "true").load(path)
    return reader.schema(schema).load(path)


def read_table(spark: SparkSession, path: str, predicate: str | Column | None = None, fmt: str = "parquet", schema=None, merge_schema: bool = False) -> DataFrame:
    """A table, and the rows of it that a predicate holds for (pushed down to the files).

    `merge_schema`: files may lack columns that others have, which are NULL there; it looks into every file, so a
    `schema` is the faster way where it is known."""
    reader = spark.read.format(fmt).option("mergeSchema", str(merge_schema).lower())
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if predicate is None else df.filter(predicate)


def write_table(df: DataFrame, path: str, partition_by: list[str], mode: str = "append") -> None:
    """Partitioned write; "overwrite" replaces only the partitions that `df` has."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def stream_to_table(df: DataFrame, path: str, checkpoint: str, partition_by: list[str], trigger: str | None = None) -> StreamingQuery:
    """Appends a stream to a partitioned table; without a trigger all that is there, then it ends."""
    writer: DataStreamWriter = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).partitionBy(*partition_by)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start(path)


def backfill_trades(spark: SparkSession, source: str, target: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """JSON files of trade messages in the shape of bronze trades, within dates (both inclusive)."""
    text = spark.read.text(source)
    day = F.to_date(F.timestamp_millis("trade_time_ms"))
    rows = json_rows(text, F.col("value"), TRADE_FIELDS).withColumn("trade_date", day)
    if start:
        rows = rows.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    empty = {"kafka_key": "string", "kafka_topic": "string", "kafka_partition": "int", "kafka_offset": "long", "kafka_timestamp": "timestamp"}
    names = [x.split(" ")[0] for x in TRADE_EVENT.split(", ")]
    out = rows.select(*names, *[F.lit(None).cast(t).alias(n) for n, t in empty.items()], F.current_timestamp().alias("ingested_at"), "trade_date")
    if target:
        write_table(out, target, ["trade_date", "symbol"])
    return out


def messages(df: DataFrame, key: Column, headers: dict[str, str] | None = None) -> DataFrame:
    """Rows as broker messages: key and JSON value in UTF-8, and headers."""
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in (headers or {}).items()]
    return df.select(key.cast("string").cast("binary").alias("key"), F.to_json(F.struct(*df.columns)).cast("binary").alias("value"), (F.array(*pairs) if pairs else F.array().cast("array<struct<key:string,value:binary>>")).alias("headers"))


def publish(df: DataFrame, servers: str, topic: str, options: dict[str, str] | None = None) -> None:
    """Messages to a topic; an event hub takes the same through its Kafka endpoint and SASL options."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**(options or {})).save()


def in_batches(sent: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """(keys, values, n, bytes): messages packed one after another into batches of at most so many bytes of keys and
    values; a message that is larger is a batch of its own. Each task packs its own rows, nothing is shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.binary())), pa.array([values], pa.list_(pa.binary())), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64())], names=["keys", "values", "n", "bytes"])

        for part in parts:
            for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = len(key or b"") + len(value or b"")
                if keys and size + own > max_bytes:
                    yield out()
                    keys, values, size = [], [], 0
                keys.append(key)
                values.append(value)
                size += own
        if keys:
            yield out()

    return sent.select("key", "value").mapInArrow(run, "keys array<binary>, values array<binary>, n long, bytes long")
