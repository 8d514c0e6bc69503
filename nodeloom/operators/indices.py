"""Internal quality indices of partitions: of features (silhouette, Calinski-Harabasz, S_Dbw) and of networks.

Vectors are frames of node, label, x (array of doubles). Centres and dispersions are grouped aggregates over
positions; only the silhouette looks at all pairs, which is its definition, in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import composition as C
from . import pairs


def positions(vectors: DataFrame) -> DataFrame:
    return vectors.select("node", "label", F.posexplode("x").alias("pos", "v"))


def centres(vectors: DataFrame) -> DataFrame:
    """label, size, centre, spread (the norm of the population variances)."""
    by_pos = positions(vectors).groupBy("label", "pos").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = by_pos.groupBy("label").agg(F.max("n").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("c"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("spread"))
    return rows.select("label", "size", F.transform("c", lambda e: e["m"]).alias("centre"), "spread")


def silhouette(vectors: DataFrame) -> DataFrame:
    """node, label, sw: exact, by Euclidean distances between all pairs in blocks, of which a sum for each label leaves a task; alone in a cluster counts as 0."""
    means = pairs.distance_sums(vectors.withColumn("labels", F.array("label"))).withColumn("d", F.col("total") / F.col("n"))
    own = F.col("label") == F.col("other")
    ab = means.groupBy("node", "label").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return ab.select("node", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("sw"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    cells = positions(vectors)
    by_label = cells.groupBy("label", "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("s"))
    overall = cells.groupBy("pos").agg(F.avg("v").alias("g"))
    sums = by_label.join(F.broadcast(overall), "pos").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("s")).alias("ssw"), F.countDistinct("label").alias("k"), (F.sum("n") / F.countDistinct("pos")).alias("n")
    )
    return sums.select(F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("ch"))


def s_dbw(vectors: DataFrame) -> DataFrame:
    """Scatter plus density between clusters; a pair without points near its centres adds nothing."""
    c = centres(vectors).select("label", "centre", "spread")
    whole = positions(vectors).groupBy("pos").agg(F.var_pop("v").alias("s")).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("all"))
    stats = c.agg(F.avg("spread").alias("sig"), (F.sqrt(F.sum("spread")) / F.count(F.lit(1))).alias("radius"), F.count(F.lit(1)).alias("k")).crossJoin(whole)
    one, two = c.select(F.col("label").alias("la"), F.col("centre").alias("ca")), c.select(F.col("label").alias("lb"), F.col("centre").alias("cb"))
    # clusters are few; pairs of centres meet the points of either cluster
    both = one.crossJoin(two).where("la < lb").withColumn("cm", F.zip_with("ca", "cb", lambda x, y: (x + y) / 2)).crossJoin(stats.select("radius"))
    points = both.join(vectors.select("label", "x"), (F.col("label") == F.col("la")) | (F.col("label") == F.col("lb")))
    near = lambda u: F.count_if(F.sqrt(C.squared_distance(F.col("x"), F.col(u))) <= F.col("radius"))
    counts = points.groupBy("la", "lb").agg(near("ca").alias("na"), near("cb").alias("nb"), near("cm").alias("nm"))
    dens = counts.agg((2 * F.sum(F.coalesce(F.try_divide("nm", F.greatest("na", "nb")), F.lit(0.0)))).alias("total"))
    return stats.crossJoin(dens).select((F.col("sig") / F.col("all") + F.coalesce("total", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).alias("s_dbw"))


def between_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """la, lb, weight: total edge weight from one label to another. Sums over source labels come before the second join."""
    one = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("la")), "src").groupBy("la", "dst").agg(F.sum("weight").alias("weight"))
    return one.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("lb")), "dst").groupBy("la", "lb").agg(F.sum("weight").alias("weight"))


def network_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """avi, avu, mq: mean inner share, mean outward overlap, modularity."""
    s = between_weights(edges, labels)
    k = labels.agg(F.countDistinct("label").alias("k"))
    rows = s.groupBy("la").agg(F.sum("weight").alias("row"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    cols = s.groupBy("lb").agg(F.sum("weight").alias("col"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inner_b"))
    total = s.agg(F.sum("weight").alias("m2"))
    first = rows.crossJoin(F.broadcast(total)).agg(
        F.avg(F.when(F.col("row") > 0, F.col("inner") / F.col("row"))).alias("avi"), F.sum(F.col("inner") / F.col("m2") - (F.col("row") / F.col("m2")) ** 2).alias("mq")
    )
    outward = s.where("la <> lb AND weight > 0").join(rows, "la").join(cols, "lb")
    second = outward.agg(F.sum(F.try_divide(F.col("weight"), F.col("row") - F.col("inner") + F.col("col") - F.col("inner_b") - F.col("weight"))).alias("u"))
    return first.crossJoin(second).crossJoin(k).select("avi", (F.coalesce("u", F.lit(0.0)) / F.col("k")).alias("avu"), "mq")


def sizes(labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("min_size"), (F.max("n") / F.sum("n")).alias("max_share"))


def renumbered(labels: DataFrame) -> DataFrame:
    """Labels 0, 1, ... by descending size, ties by the old label."""
    from pyspark.sql import Window

    order = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("new", (F.row_number().over(Window.orderBy(F.col("n").desc(), "label")) - 1).cast("long"))
    return labels.join(F.broadcast(order.select("label", "new")), "label").select("node", F.col("new").alias("label"))
