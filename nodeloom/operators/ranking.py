"""Ranks of candidates by several indices, and their aggregation.

A table of candidates is long: candidate, index, value, with one direction for each index (1: more is better). Ranks are
windows over the partition of an index, so the number of candidates, not of data rows, bounds a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed


def average_rank(order: Column, by: list[str] | None = None, key: Column | None = None) -> Column:
    """The rank in `order`, ties sharing their mean; pass the ordered column as `key` if `order` has a direction of nulls."""
    partition = Window.partitionBy(*by) if by else Window.partitionBy()
    up, down = F.rank().over(partition.orderBy(order)), F.count(F.lit(1)).over(partition.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return (up + down) / 2


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """`df` with the sum of `amount` over rows up to its own in `order`, whose values are distinct; no task sorts all rows.

    Ranges of the order are sorted each on their own; the sums of the ranges before, a row a range, are added.
    """
    # ranges come from a sample, so they are written before they are used twice
    dealt = checkpointed(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(out, within).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def with_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with the ascending rank of a column, ties sharing their mean, from the counts of its distinct values; nulls stay null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_t"))
    ranked = running_total(counts, "_v", "_t", "_up").select("_v", (F.col("_up") - (F.col("_t") - 1) / 2).alias(out))
    return df.join(ranked, F.col(column) == F.col("_v"), "left").drop("_v")


def rank_table(values: DataFrame, directions: dict[str, int]) -> DataFrame:
    """candidate, index, value, place: average ranks, the best first, nulls last."""
    sign = F.lit(None).cast("double")
    for name, direction in directions.items():
        sign = F.when(F.col("index") == name, F.lit(float(direction))).otherwise(sign)
    signed = values.where(F.col("index").isin(*directions)).withColumn("_s", F.col("value") * sign)
    return signed.withColumn("place", average_rank(F.col("_s").desc_nulls_last(), ["index"])).drop("_s")


def borda(ranks: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """candidate, borda: the sum over indices of (candidates - place), weighted if asked."""
    n = F.count(F.lit(1)).over(Window.partitionBy("index"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("index") == name, w).otherwise(weight)
    return ranks.withColumn("points", (n - F.col("place")) * weight).groupBy("candidate").agg(F.sum("points").alias("borda"))


def copeland(ranks: DataFrame) -> DataFrame:
    """candidate, copeland: candidates beaten in a majority of indices, less those that beat it.

    All pairs of candidates are compared index by index: the size is candidates squared, by definition of the score.
    """
    a = ranks.select("candidate", "index", "place")
    b = ranks.select(F.col("candidate").alias("other"), "index", F.col("place").alias("other_place"))
    duels = a.join(b, "index").groupBy("candidate", "other").agg(F.sum(F.signum(F.col("other_place") - F.col("place"))).alias("won"))
    return duels.groupBy("candidate").agg(F.sum(F.signum("won")).cast("long").alias("copeland"))


def aggregate(ranks: DataFrame) -> DataFrame:
    """candidate, borda, copeland and the places by each (the least rank for ties)."""
    both = borda(ranks).join(copeland(ranks), "candidate")
    place = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))
    return both.withColumn("borda_place", place("borda")).withColumn("copeland_place", place("copeland"))


def kendall_w(ranks: DataFrame) -> DataFrame:
    """Kendall's coefficient of concordance without a correction for ties."""
    sums = ranks.groupBy("candidate").agg(F.sum("place").alias("total"), F.count(F.lit(1)).alias("m"))
    stats = sums.agg(F.var_pop("total").alias("v"), F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return stats.select(F.try_divide(12 * F.col("v") * n, m * m * (n * n * n - n)).alias("w"))


def choose(ranked: DataFrame, stability: DataFrame, least: float) -> DataFrame:
    """The first candidate by Borda among those with a mean stability of at least `least`; an error if there is none."""
    best = ranked.join(stability, "candidate").where(F.col("stability") >= least).orderBy("borda_place", "copeland_place", "candidate").limit(1)
    if not best.count():
        raise ValueError("no candidate is stable enough")
    return best


def admissible(sizes: DataFrame, n: int, least_share: float = 0.01, most_share: float = 0.6, most_clusters: int = 24) -> DataFrame:
    """Candidates whose clusters are neither too small nor too large nor too many: candidate, k, min_size, max_share."""
    found = sizes.groupBy("candidate").agg(F.count(F.lit(1)).alias("k"), F.min("size").alias("min_size"), (F.max("size") / n).alias("max_share"))
    return found.where((F.col("min_size") >= least_share * n) & (F.col("max_share") <= most_share) & F.col("k").between(2, most_clusters))
