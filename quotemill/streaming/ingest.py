"""Streams of quotes: files as they arrive, duplicates dropped within a watermark, published by the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quotemill.operators.merge import upsert


def file_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def distinct_readings(stream: DataFrame, at: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """The first of repeated readings; what comes later than the watermark is not kept in state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, at: str, keys: Sequence[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window of event time and keys; late rows count until the watermark passes the window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def publish_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merges each micro-batch into the table at path. A batch that runs again after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(transform(batch) if transform else batch, path, keys)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
