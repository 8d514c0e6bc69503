"""Weighted graphs as edge tables: src, dst, weight, both directions present, no loops, absent pairs absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import composition as C
from . import pairs


def canonical_pairs(edges: DataFrame, a: str, b: str, distance: str, zero: float = 1.0) -> DataFrame:
    """a < b, the mean over both directions and repeats, its spread; distances that are not positive become `zero`."""
    one_way = edges.where((F.col(a) != F.col(b)) & F.col(distance).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(distance).alias("d"))
    means = one_way.groupBy("a", "b").agg(F.avg("d").alias("distance"), (F.max("d") - F.min("d")).alias("spread"))
    return means.withColumn("distance", F.when(F.col("distance") <= 0, zero).otherwise(F.col("distance")))


def symmetric(links: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    forward = links.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(weight).alias("weight"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subgraph on `nodes` (column node)."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return out.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def knn_graph(vectors: DataFrame, k: int, by: list[str] | None = None, mutual: bool = False) -> DataFrame:
    """A symmetric graph of the k nearest others by cosine: the larger weight of either direction, or the smaller where both chose."""
    chosen = pairs.nearest(vectors, k, pairs.cosine, by).where("weight > 0").select("src", "dst", "weight")
    both = chosen.unionByName(chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    grouped = both.groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.min("weight").alias("low"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n = 2").select("src", "dst", F.col("low").alias("weight")) if mutual else grouped.select("src", "dst", "weight")


def kernel(links: DataFrame, sigma: float = 150.0) -> DataFrame:
    return symmetric(links.select("a", "b", C.distance_kernel(F.col("distance"), sigma).alias("weight")))


def multiplex(layers: list[tuple[DataFrame, float]], equal_mass: bool = False) -> DataFrame:
    """The weighted sum of layers, each over its mean weight (or, for equal masses, over its total)."""
    out = None
    for edges, weight in layers:
        scale = edges.agg((F.sum("weight") if equal_mass else F.avg("weight")).alias("_s"))
        part = edges.crossJoin(F.broadcast(scale)).select("src", "dst", (F.col("weight") / F.col("_s") * weight).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def layer_masses(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, share: of the multiplex's total weight, by layers over their mean weights."""
    out = None
    for name, edges in layers.items():
        part = edges.agg((F.sum("weight") / F.avg("weight")).alias("mass")).withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    total = out.agg(F.sum("mass").alias("_t"))
    return out.crossJoin(F.broadcast(total)).select("layer", (F.col("mass") / F.col("_t")).alias("share"))


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_edges, mean_degree, isolated."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    joined = nodes.select("node").join(degree, "node", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.expr("cast(coalesce(sum(d), 0) div 2 as bigint)").alias("n_edges"),
        F.avg(F.coalesce("d", F.lit(0))).alias("mean_degree"), F.count_if(F.col("d").isNull()).alias("isolated"),
    )


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_both, n_any, jaccard of two undirected edge sets."""
    one = a.where("src < dst").select("src", "dst").distinct().withColumn("_a", F.lit(1))
    two = b.where("src < dst").select("src", "dst").distinct().withColumn("_b", F.lit(1))
    counted = one.join(two, ["src", "dst"], "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return counted.withColumn("jaccard", F.try_divide("n_both", "n_any"))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the least node reachable); isolated nodes are their own.

    Labels go to the least of the neighbours' labels and then to the label's own label, until nothing changes; the
    number of rounds is logarithmic in the longest path. Every round is checkpointed in the shared folder.
    """
    from ..sources.storage import checkpointed

    edges = checkpointed(edges.select("src", "dst"))
    labels = checkpointed(nodes.select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        heard = edges.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("m")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("m").alias("m"))
        lowered = labels.join(heard, "node", "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("low"))
        roots = lowered.select(F.col("node").alias("low"), F.col("low").alias("root"))
        after = checkpointed(lowered.join(roots, "low").select("node", F.least("low", "root").alias("component"), F.col("component").alias("was")))
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise ValueError("components did not settle")


def inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends have one label."""
    one, two = labels.select(F.col("node").alias("src"), F.col("label").alias("_s")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_d"))
    return edges.join(one, "src").join(two, "dst").where("_s = _d").drop("_s", "_d")


def type_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n_nodes, n_components, largest_share: components inside each label."""
    found = components(inside(edges, labels), labels).join(labels, "node")
    sizes = found.groupBy("label", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("label").agg(F.sum("size").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), (F.max("size") / F.sum("size")).alias("largest_share"))


def neighbour_mean(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """node and the weighted mean over its neighbours that have a value."""
    joined = edges.join(values.select(F.col("node").alias("dst"), F.col(column).alias("_v")), "dst").where("_v IS NOT NULL")
    return joined.groupBy(F.col("src").alias("node")).agg(F.try_divide(F.sum(F.col("weight") * F.col("_v")), F.sum("weight")).alias("neighbour_mean"))


def standard_values(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """z scores over nodes that have neighbours."""
    linked = values.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    stats = linked.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return linked.crossJoin(F.broadcast(stats)).select("node", ((F.col(column) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("z"))


def spatial_lag(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """node, z, lag, local: the row-standardised mean of neighbours' z, and Moran's local product."""
    z = standard_values(edges, values, column)
    lag = neighbour_mean(edges, z, "z").withColumnRenamed("neighbour_mean", "lag")
    return z.join(lag, "node").withColumn("local", F.col("z") * F.col("lag"))


def morans_i(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    return spatial_lag(edges, values, column).agg(F.try_divide(F.sum("local"), F.sum(F.col("z") * F.col("z"))).alias("i"), F.count(F.lit(1)).alias("n"))


def quadrants(edges: DataFrame, values: DataFrame, column: str) -> DataFrame:
    high, near = F.when(F.col("z") > 0, "H").otherwise("L"), F.when(F.col("lag") > 0, "H").otherwise("L")
    return spatial_lag(edges, values, column).withColumn("quadrant", F.concat(high, near))


def modularity_cells(edges: DataFrame) -> DataFrame:
    """The existing cells of A - r cᵀ / total; cells without an edge are the rank-one term alone."""
    strength = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    total = edges.agg(F.sum("weight").alias("_t"))
    one = strength.select(F.col("node").alias("src"), F.col("k").alias("_r"))
    two = strength.select(F.col("node").alias("dst"), F.col("k").alias("_c"))
    return edges.join(one, "src").join(two, "dst").crossJoin(F.broadcast(total)).select("src", "dst", (F.col("weight") - F.col("_r") * F.col("_c") / F.col("_t")).alias("b"))
