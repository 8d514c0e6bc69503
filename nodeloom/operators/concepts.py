"""Formal concepts. A node's attributes are the bits of a long, so an extent's intent is one bit_and."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, columns: list[str], q: float = 1 / 3, extreme: float | None = 0.1) -> DataFrame:
    """node, mask. Of each column four bits: upper part, lower part, upper tail, lower tail (inclusive bounds)."""
    if len(columns) * 4 > 62:
        raise ValueError("too many attributes for one mask")
    levels = [1 - q, q] + ([1 - extreme, extreme] if extreme else [])
    # cuts are rounded: interpolation must not move a value off a quantile that it is itself
    cuts = df.agg(*[F.transform(F.percentile(c, F.array(*[F.lit(x) for x in levels])), lambda v: F.round(v, 9)).alias(f"_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(cuts))
    mask = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        for i in range(len(levels)):
            hit = F.col(c) >= F.col(f"_{c}")[i] if i % 2 == 0 else F.col(c) <= F.col(f"_{c}")[i]
            mask = mask + F.when(hit, F.lit(1 << (4 * k + i)).cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.select("node", mask.alias("mask"))


def attribute_names(columns: list[str]) -> list[str]:
    return [f"{mark} {c}" for c in columns for mark in ("high", "low", "very high", "very low")]


def combos(spark, attributes: int, most: int = 3) -> DataFrame:
    """combo, length: all sets of up to `most` attributes as masks."""
    rows = [(sum(1 << i for i in c), r) for r in range(1, most + 1) for c in combinations(range(attributes), r)]
    return spark.createDataFrame(rows, "combo long, length int")


def extents(masks: DataFrame, sets: DataFrame, least: int = 10) -> DataFrame:
    """combo, length, intent, extent. Nodes with one mask are counted once: their masks, not the nodes, meet the sets."""
    grouped = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    hits = grouped.join(F.broadcast(sets), F.expr("mask & combo = combo"))
    return hits.groupBy("combo", "length").agg(F.bit_and("mask").alias("intent"), F.sum("n").alias("extent")).where(F.col("extent") >= least)


def concepts(masks: DataFrame, sets: DataFrame, least: int = 10) -> DataFrame:
    """intent, extent of every concept that up to three attributes generate."""
    return extents(masks, sets, least).groupBy("intent").agg(F.max("extent").alias("extent"))


def generators(masks: DataFrame, sets: DataFrame, least: int = 10) -> DataFrame:
    """intent, generator: the shortest set with the concept's extent, the first by its attributes."""
    reverse = F.reverse(F.lpad(F.bin("combo"), 64, "0"))
    over = Window.partitionBy("intent").orderBy("length", reverse.desc())
    return extents(masks, sets, least).withColumn("_r", F.row_number().over(over)).where("_r = 1").select("intent", F.col("combo").alias("generator"), "length")


def delta(masks: DataFrame, found: DataFrame, attributes: int) -> DataFrame:
    """intent, delta: how many nodes an extent loses at least when one more attribute is asked for."""
    grouped = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    inside = grouped.join(F.broadcast(found.select("intent", "extent")), F.expr("mask & intent = intent"))
    bits = [F.sum(F.when(F.expr(f"mask & {1 << b}L <> 0 AND intent & {1 << b}L = 0"), F.col("n")).otherwise(0)).alias(f"_{b}") for b in range(attributes)]
    counted = inside.groupBy("intent", "extent").agg(*bits)
    return counted.select("intent", (F.col("extent") - F.greatest(*[F.col(f"_{b}") for b in range(attributes)])).alias("delta"))


def describe(masks: DataFrame, labels: DataFrame, sets: DataFrame, least: int = 10, precision: float = 0.6, top: int = 3) -> DataFrame:
    """label, place, intent, extent, precision, coverage: the best concepts of each label by F measure, then by length."""
    found = concepts(masks, sets, least)
    by_mask = masks.join(labels, "node").groupBy("mask", "label").agg(F.count(F.lit(1)).alias("n"))
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_k"))
    hits = by_mask.join(F.broadcast(found), F.expr("mask & intent = intent")).groupBy("label", "intent", "extent").agg(F.sum("n").alias("hit"))
    scored = hits.join(F.broadcast(size), "label").withColumn("precision", F.col("hit") / F.col("extent")).withColumn("coverage", F.col("hit") / F.col("_k")).where(F.col("precision") >= precision)
    f = F.round(2 * F.col("precision") * F.col("coverage") / (F.col("precision") + F.col("coverage")), 12)
    over = Window.partitionBy("label").orderBy(f.desc(), F.bit_count("intent"), "intent")
    return scored.withColumn("place", F.row_number().over(over)).where(F.col("place") <= top).select("label", "place", "intent", "extent", "precision", "coverage")
