"""Partitions over time: nearest prototypes, transitions, trajectories, yearly modes, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import composition as C
from .indices import centres


def nearest_centre(vectors: DataFrame, centre_rows: DataFrame, cosine: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """node (with its other columns) and assigned: the centre at the least squared distance (or cosine distance).

    `extra` adds a constant term of node and label, such as a network's. Centres are as many as labels: they are
    broadcast, and the argmin is an aggregate over an array, not a shuffle.
    """
    rows = centre_rows.select(F.struct("label", "centre").alias("c")).agg(F.sort_array(F.collect_list("c")).alias("cs"))
    gap = (lambda x, c: 2 - 2 * C.cosine_similarity(x, c)) if cosine else C.squared_distance
    joined = vectors.crossJoin(F.broadcast(rows))
    if extra is not None:
        terms = extra.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("label", "term"))).alias("_t"))
        joined = joined.join(terms, "node", "left").withColumn("_t", F.coalesce("_t", F.create_map().cast("map<bigint,double>")))
        scored = F.transform("cs", lambda c: F.struct(F.round(gap(F.col("x"), c["centre"]) + F.coalesce(F.element_at("_t", c["label"]), F.lit(0.0)), 12).alias("d"), c["label"].alias("label")))
    else:
        scored = F.transform("cs", lambda c: F.struct(F.round(gap(F.col("x"), c["centre"]), 12).alias("d"), c["label"].alias("label")))
    keep = [c for c in vectors.columns if c != "x"]
    return joined.select(*keep, F.array_min(scored)["label"].alias("assigned"))


def assign_periods(vectors: DataFrame, cosine: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """Vectors of node, period, label, x: each node-period goes to the nearest mean of a label over all periods."""
    return nearest_centre(vectors, centres(vectors).select("label", "centre"), cosine, extra)


def trajectories(labels: DataFrame, min_run: int = 2) -> DataFrame:
    """node, changes, trajectory from node, period, label: stable, persistent shift, or fluctuation."""
    over = Window.partitionBy("node").orderBy("period")
    moved = labels.withColumn("_p", F.row_number().over(over) - 1).withColumn("_c", F.coalesce((F.col("label") != F.lag("label").over(over)).cast("int"), F.lit(0)))
    found = moved.groupBy("node").agg(F.sum("_c").alias("changes"), F.min(F.when(F.col("_c") == 1, F.col("_p"))).alias("_at"), F.count(F.lit(1)).alias("_n"))
    name = F.when(F.col("changes") == 0, "stable").when((F.col("changes") == 1) & (F.col("_n") - F.col("_at") >= min_run), "persistent shift").otherwise("fluctuation")
    return found.select("node", "changes", name.alias("trajectory"))


def transitions(labels: DataFrame) -> DataFrame:
    """label, following, n: from each period to the next one the node has."""
    over = Window.partitionBy("node").orderBy("period")
    return labels.withColumn("following", F.lead("label").over(over)).where("following IS NOT NULL").groupBy("label", "following").agg(F.count(F.lit(1)).alias("n"))


def mode_last(labels: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent label of each group; of equally frequent ones the one that came last."""
    counts = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n"), F.max("period").alias("_p"))
    over = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col("_p").desc(), "label")
    return counts.withColumn("_r", F.row_number().over(over)).where("_r = 1").select(*by, F.col("label").alias("mode"))


def label_shares(labels: DataFrame) -> DataFrame:
    """period, label, share."""
    counts = labels.groupBy("period", "label").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("period", "label", (F.col("_n") / F.sum("_n").over(Window.partitionBy("period"))).alias("share"))


def persistent_moves(labels: DataFrame, check: DataFrame, first: int, last: int) -> DataFrame:
    """node, origin, target of nodes that moved between the first and last windows, had settled by the one before the
    last, and moved likewise in a second partition."""
    wide = lambda df, a: df.groupBy("node").agg(
        F.max(F.when(F.col("period") == first, F.col("label"))).alias(f"{a}0"), F.max(F.when(F.col("period") == last - 3, F.col("label"))).alias(f"{a}1"), F.max(F.when(F.col("period") == last, F.col("label"))).alias(f"{a}2")
    )
    joined = wide(labels, "a").join(wide(check, "b"), "node")
    return joined.where("a0 <> a2 AND a1 = a2 AND b0 <> b2").select("node", F.col("a0").alias("origin"), F.col("a2").alias("target"))
