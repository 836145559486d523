"""Streams of points and matches against a fixed reference. An extension: batch semantics are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators import warp as W


def warp_stream(spark: SparkSession, source: str, schema: str, transforms: DataFrame) -> DataFrame:
    """Points that arrive as Parquet files in a folder, in the registered frame: a stream joined to a table."""
    return W.warp_points(spark.readStream.schema(schema).parquet(source), transforms)


def error_windows(matches: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, image1, image2, n, mean_error) by window of time; rows later than ``late`` are left out."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    g = matches.withWatermark(time, late).groupBy(F.window(time, window), "image1", "image2")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("mean_error")).select(F.col("window.start").alias("start"), "image1", "image2", "n", "mean_error")


def write_stream(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet and stops when what is there has been read; the checkpoint makes a restart go on."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
