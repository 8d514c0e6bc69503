"""Streaming forms of the panel: the same cells from a stream of events, with a bound on how late an event may come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New Parquet files below a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def streamed_cells(events: DataFrame, node: str, time: str, category: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """node, start, category, value, n per tumbling window; a window is final once the watermark has passed it."""
    kept = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = kept.groupBy(F.col(node).alias("node"), F.window(time, width).alias("w"), F.col(category).alias("category"))
    return grouped.agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n")).select("node", F.col("w.start").alias("start"), "category", "value", "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there to Parquet, exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
