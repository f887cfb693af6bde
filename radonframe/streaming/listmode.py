"""Block-wise ingestion of listmode events into a running histogram with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev


def stream_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet event files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_histogram(stream: DataFrame, scanner: ev.Scanner, tof_bins: int | None = None) -> DataFrame:
    """The running histogram (a, r, p[, tof], value) of a stream of decoded events: state is one sum per cell."""
    return ev.histogram(stream, scanner, tof_bins=tof_bins)


def count_rates(stream: DataFrame, block: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window, n) per tumbling block of event time ts; later events than the watermark allows are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", block)).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is there now, in a table of the session."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
