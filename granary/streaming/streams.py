"""Structured Streaming forms of the record operators: reading, first-wins dedup, routing, counts and resumption."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "csv", files: int = 64, **options) -> DataFrame:
    """Files of a folder as they come, `files` a batch at most, so that a backlog doesn't become one batch."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def first_wins(stream: DataFrame, key: Column, time: str, late: str) -> DataFrame:
    """One row per key within the watermark; state holds a digest a key and ends with the watermark, so it is bounded."""
    return stream.withColumn("_key", F.sha2(key, 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def window_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Rows and value sums by time window and keys. An extension: the batch operators have no event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide or width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def run(stream: DataFrame, path: str, checkpoint: str, progress: str | None = None, form: str = "parquet") -> StreamingQuery:
    """Writes all that is there and stops; a second run goes on from the checkpoint. progress: name of a row counter."""
    if progress:
        stream = stream.observe(progress, F.count(F.lit(1)).alias("rows"))
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
