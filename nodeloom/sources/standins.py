"""The star-schema tables read as the engine's own inputs: panel, distances, versions, statistics, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The panel's named categories; what a total has besides them is the residual category.
NAMED = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
RESIDUAL = "STANDARD"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period_of(ts, grain: str):
    """A consecutive number for the year, quarter or month of a timestamp column."""
    if grain == "year":
        return F.year(ts).cast("long")
    if grain == "quarter":
        return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("long")
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def span(spark: SparkSession, sf_dir: str, grain: str) -> tuple[int, int]:
    """The first and last period of the panel, from the data."""
    period = period_of(F.col("l_shipdate"), grain)
    row = load(spark, sf_dir, "lineitem").agg(F.min(period).alias("first"), F.max(period).alias("last")).first()
    return row["first"] or 0, row["last"] or 0


def cells(spark: SparkSession, sf_dir: str, grain: str = "year") -> DataFrame:
    """The long panel: node (supplier), period, category (part type), value (revenue)."""
    items = load(spark, sf_dir, "lineitem")
    items = items.select("l_partkey", F.col("l_suppkey").alias("node"), period_of(F.col("l_shipdate"), grain).alias("period"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    # revenue is summed by part before the join, which then sees a row for each part and cell
    summed = items.groupBy("l_partkey", "node", "period").agg(F.sum("value").alias("value"))
    return summed.join(parts, "l_partkey").groupBy("node", "period", "category").agg(F.sum("value").alias("value"))


def totals(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """node, period, value over all categories."""
    period = period_of(F.col("l_shipdate"), grain).alias("period")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node"), period).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, label and x (array of doubles) from the embeddings."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def node_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node (supplier), nation, region."""
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey", "s_acctbal")
    return suppliers.join(F.broadcast(nations), "s_nationkey").select("node", F.col("s_nationkey").cast("long").alias("nation"), "region", "s_acctbal")


_PERIOD = {"year": "year({c})", "quarter": "year({c}) * 4 + quarter({c}) - 1", "month": "year({c}) * 12 + month({c}) - 1"}


def period_sql(grain: str) -> str:
    return f"CAST({_PERIOD[grain].format(c='l_shipdate')} AS BIGINT)"


def span_sql(grain: str) -> tuple[str, str]:
    """The oracle's first and last period, as scalar subqueries."""
    return tuple(f"(SELECT {f}({period_sql(grain)}) FROM lineitem)" for f in ("min", "max"))


def cells_sql(grain: str = "year") -> str:
    """The oracle's version of `cells`, as a subquery."""
    return (
        f"(SELECT l_suppkey AS node, {period_sql(grain)} AS period, p_type AS category, sum(l_extendedprice * (1 - l_discount)) AS value "
        f"FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
    )


def totals_sql(grain: str = "month") -> str:
    return f"(SELECT l_suppkey AS node, {period_sql(grain)} AS period, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY ALL)"
