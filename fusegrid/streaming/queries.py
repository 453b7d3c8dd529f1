"""Streaming sources and sinks, and the event-time as-of join."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; the number of files a trigger is the load limit."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def run_once(stream: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Append all available rows to a folder, restartably, and return what is there."""
    q = stream.writeStream.format(fmt).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.format(fmt).schema(stream.schema).load(folder)


@contextmanager
def with_rocksdb(spark: SparkSession):
    """State of streams started inside is kept in RocksDB, which operators with typed state need; the setting is restored after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def asof_stream(lidar: DataFrame, rgb: DataFrame, slop_ms: float = 35.0) -> DataFrame:
    """The latest image within the slop before each scan, as an event-time interval join and aggregation.

    Both sides have ``ts`` (timestamp) and ``ts_ns``; state older than the slop goes with the
    watermark, which waits for images as late as the slop.
    """
    slop_us = int(slop_ms * 1000)
    late = f"{slop_us} microseconds"
    bucket = lambda c: F.floor(F.unix_micros(c) / slop_us)  # noqa: E731  an image is in the scan's bucket or the one before
    a = lidar.withWatermark("ts", late).withColumn("bucket", bucket("ts")).alias("l")
    b = rgb.select(F.col("ts").alias("rgb_ts"), F.col("ts_ns").alias("rgb_ns"), F.col("idx").alias("rgb_idx")).withWatermark("rgb_ts", late)
    b = b.withColumn("bucket", F.explode(F.array(bucket("rgb_ts"), bucket("rgb_ts") + 1))).alias("r")
    near = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("rgb_ts") <= F.col("l.ts")) & (F.col("rgb_ts") >= F.col("l.ts") - F.expr(f"interval {late}"))
    pairs = a.join(b, near)
    g = pairs.groupBy("ts", "idx", "ts_ns").agg(F.max(F.struct("rgb_ns", "rgb_idx")).alias("r"))
    return g.select(F.col("idx").alias("lidar_idx"), F.col("r.rgb_idx").alias("rgb_idx"), (F.col("ts_ns") - F.col("r.rgb_ns")).alias("age_ns"))
