"""Nearest others of a node under several rules, and how well they stand in for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs


def analogs(vectors: DataFrame, k: int = 7, same: str | None = None, first: str | None = None) -> DataFrame:
    """src, dst, place: the k nearest others by squared distance (ties to the smaller id).

    `same` restricts to others with an equal value of that column; `first` (a column of whole numbers) puts others with
    an equal value before all the rest, of whom as many are looked up as the nodes of short groups may need.
    """
    if not first:
        return pairs.nearest(vectors, k, pairs.closeness, [same] if same else None).select("src", "dst", "place")
    own = pairs.nearest(vectors, k, pairs.closeness, [first]).drop(first).withColumn("far", F.lit(0))
    rest = pairs.nearest(vectors, k, pairs.closeness, unlike=first).withColumn("far", F.lit(1))
    over = Window.partitionBy("src").orderBy("far", "_place")
    both = own.unionByName(rest).withColumnRenamed("place", "_place")
    return both.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k).select("src", "dst", "place")


def deviation(found: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The median over nodes of |mean of analogs - own| in sample deviations of the column."""
    known = values.where(F.col(column).isNotNull())
    means = found.join(known.select(F.col("node").alias("dst"), F.col(column).alias("_v")), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("_v").alias("_m"))
    scale = known.agg(F.stddev_samp(column).alias("_s"))
    gaps = known.join(means, "node").crossJoin(F.broadcast(scale)).select(F.try_divide(F.abs(F.col("_m") - F.col(column)), F.col("_s")).alias("d"))
    return gaps.agg(F.median("d").alias("median_deviation"), F.count(F.lit(1)).alias("n"))
