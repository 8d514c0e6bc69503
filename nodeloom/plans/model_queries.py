"""Queries on clustering, regression, permutation tests and resampling. Most are iterative or random: no SQL says them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import composition as C
from ..operators import clustering, selection, stats, validation
from ..sources import standins as S
from ..sources.storage import checkpointed
from . import graph_queries as gq
from .registry import query

@query()
def kmeans(spark, sf):
    """L1: the best of several runs."""
    return clustering.run("kmeans", S.vectors(spark, sf), 6, runs=4)


@query()
def gaussian_mixture(spark, sf):
    """L2: full covariances of all dimensions."""
    return clustering.run("gmm", S.vectors(spark, sf), 4, runs=5)


@query()
def ward(spark, sf):
    """L3."""
    return clustering.run("ward", S.vectors(spark, sf), 6)


@query()
def leiden(spark, sf):
    """Communities of the main component, the rest attached by features."""
    return clustering.run("leiden", S.vectors(spark, sf), 0, gq.knn(spark, sf), resolution=1.0)


@query()
def spectral(spark, sf):
    """L9."""
    return clustering.run("spectral", S.vectors(spark, sf), 6, gq.knn(spark, sf))


@query()
def spectral_joint(spark, sf):
    """Spectral on the multiplex of structure and another network."""
    return clustering.spectral_joint(gq.knn(spark, sf, 5, True), gq.knn(spark, sf), S.vectors(spark, sf), 6)


@query()
def kefrin(spark, sf):
    """Features and network together."""
    return clustering.run("kefrin", S.vectors(spark, sf), 6, gq.knn(spark, sf, 5, True), runs=5)


@query(f"SELECT sum(s * n) AS criterion FROM (SELECT var_pop(v) AS s, count(*) AS n FROM {gq.CELLS} GROUP BY label, pos)", "criterion")
def partition_criterion(spark, sf):
    """The within sum of squares of given labels."""
    return clustering.partition_criterion(S.vectors(spark, sf))


@query()
def kruskal_p(spark, sf):
    """The tail of the Kruskal-Wallis statistic."""
    p = validation.kruskal_p(S.load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return spark.createDataFrame([(float(p),)], "p double")


@query(
    "SELECT 'const' AS term, regr_intercept(l_extendedprice, l_quantity) AS beta FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem", "beta"
)
def ols_slope(spark, sf):
    """Coefficients of a regression on one column."""
    fitted = stats.ols(S.load(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_suppkey"), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return spark.createDataFrame(fitted[["term", "beta"]])


@query()
def ols_clustered(spark, sf):
    """Standard errors by cluster, and the identity of a log ratio's coefficients."""
    t = S.load(spark, sf, "orders").join(S.load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select("c_nationkey", (F.col("c_acctbal") + 1000).alias("income"), "o_totalprice", (F.col("o_orderkey") % 7).cast("double").alias("size"))
    t = stats.scaled_design(t.withColumn("spend", F.ln("o_totalprice")).withColumn("earn", F.ln("income")).withColumn("ratio", F.col("spend") - F.col("earn")), ["size"])
    found = [stats.ols(t, y, ["size"], "c_nationkey").assign(outcome=y) for y in ("spend", "earn", "ratio")]
    return spark.createDataFrame(pd.concat(found))


@query()
def dummy_prediction(spark, sf):
    """Least squares on dummies of two groupings."""
    c = S.load(spark, sf, "customer")
    return stats.dummy_prediction(c.where("c_custkey % 5 <> 0"), c.where("c_custkey % 5 = 0"), ["c_mktsegment", "c_nationkey"], "c_acctbal").select("c_custkey", "predicted")


@query()
def wilcoxon(spark, sf):
    """Signed ranks of differences between two halves."""
    d = S.load(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))) - F.avg(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")))).alias("d"))
    return spark.createDataFrame([(float(stats.wilcoxon_p(d, "d")),)], "p double")


@query()
def moran_test(spark, sf):
    """The permutation p of Moran's I."""
    i, p = stats.moran_test(gq.knn(spark, sf), gq.first(spark, sf), "v")
    return spark.createDataFrame([(float(i), float(p))], "i double, p double")


@query()
def local_moran(spark, sf):
    """Conditional permutations, q values, named clusters."""
    return stats.local_moran(gq.knn(spark, sf), gq.first(spark, sf), "v", 199, 2)


@query()
def community_strength(spark, sf):
    """Modularity against graphs of the same degrees."""
    found = stats.community_strength(gq.knn(spark, sf), gq.labels(spark, sf))
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found))


@query()
def subsample_stability(spark, sf):
    """Agreement of subsample partitions with the whole."""
    found = stats.stability(lambda v, seed: clustering.kmeans(v, 5, 1, seed), S.vectors(spark, sf), runs=4)
    return spark.createDataFrame([tuple(float(v) for v in found.values())], ", ".join(f"{k} double" for k in found))


@query()
def dtw_similarity(spark, sf):
    """Warped similarity of all pairs of quarterly series."""
    nodes = S.totals(spark, sf, "quarter").groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("period", F.ln("value").alias("v")))), lambda e: e["v"]).alias("x"))
    return stats.dtw_similarity(nodes)


@query()
def synthetic_benchmark(spark, sf):
    """Planted partitions in four scenarios."""
    return stats.benchmark(spark, n=90, degrees=(8.0, 16.0), repeats=2)


@query()
def match_partitions(spark, sf):
    """A one-to-one map between two partitions."""
    both = clustering.run("kmeans", S.vectors(spark, sf), 6, runs=2).withColumnRenamed("label", "other").join(gq.labels(spark, sf), "node")
    return spark.createDataFrame(sorted((int(a), int(b)) for a, b in validation.match_labels(both, "label", "other").items()), "other long, label long")


@query()
def select_partition(spark, sf):
    """A grid of all families over two networks, six indices, ranks, the stability of the leading
    one by three subsamples, and which of them is chosen. Grid and counts are smaller than a full study's."""
    vectors = S.vectors(spark, sf)
    networks = {"all": checkpointed(gq.knn(spark, sf)), "label": checkpointed(gq.knn(spark, sf, 5, True))}
    codes = vectors.select("node", C.pair_codes(F.col("x"), 4).alias("codes"))
    candidates = selection.grid(spark, [4], ["all"], [1.0], ["cosine"], [1.0, 4.0], ("kmeans", "ward", "pattern"))

    def cluster(row, some, seed):
        known = selection.restricted(networks, some)
        return selection.labels_of(row, some, known, codes.join(some.select("node"), "node", "left_semi"), known["label"], runs=2)

    table, best = selection.select(candidates, cluster, vectors, networks, "all", top=1, runs=3, least=-1.0)
    return table.join(best.select("candidate", F.lit(True).alias("chosen")), "candidate", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
