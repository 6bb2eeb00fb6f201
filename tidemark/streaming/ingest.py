"""Streaming reads of run stores: each rollout once, within a watermark, into a run's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def follow(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """New parts of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def once(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """The first delivery of each key; keys are forgotten once the watermark is `delay` past them, so the state is bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, window: str, by: str, delay: str = "1 day") -> DataFrame:
    """Rows per window of event time and value of a column; late rows within the delay still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stops."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
