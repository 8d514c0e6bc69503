"""Composite pipelines: several operators in one query, end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import composition as C
from ..operators import dynamics, graph, indices, panel, ranking, records, validation
from ..sources import standins as S
from ..sources.storage import checkpointed
from . import graph_queries as gq
from . import panel_queries as pq
from . import record_queries as rq
from .registry import query

# -- P2: the reference table

_NAMES = "(SELECT s_suppkey AS node, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, s_acctbal > 5000 AS active, s_nationkey IN (0, 7) AS federal, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 100 END AS lat, s_suppkey * 1.5 AS c_lat FROM supplier)"


@query(f"SELECT node, name AS title, nation, active, federal, coalesce(lat, c_lat) AS lat FROM {_NAMES}", "lat")
def load_reference(spark, sf):
    """Names, flags by membership, and places with the centroid as fallback."""
    s = S.load(spark, sf, "supplier").withColumnRenamed("s_name", "title")
    lat = F.coalesce(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") / 100), F.col("s_suppkey") * 1.5)
    return s.select(F.col("s_suppkey").alias("node"), "title", F.col("s_nationkey").cast("long").alias("nation"), (F.col("s_acctbal") > 5000).alias("active"), F.col("s_nationkey").isin(0, 7).alias("federal"), lat.alias("lat"))


# -- P5, P6: one table of a node's attributes, and its features


def _labour(spark, sf):
    spine = S.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    means = records.mean_of_years(records.annual_mean(S.totals(spark, sf, "year").where("(node + period) % 6 <> 0"), "node", "period", "value"), "node").withColumnRenamed("value", "population")
    wide = rq.sectors(spark, sf).groupBy("node").pivot("group", ["goods", "services", "trade"]).agg(F.first("share"))
    rest = records.unallocated(rq.sectors(spark, sf), "node")
    shops = rq.retail_objects(spark, sf)
    urban = rq.urban_share(spark, sf)
    return reduce(lambda a, b: a.join(b, "node", "left"), [means, wide, rest, shops, urban], spine)


_LABOUR = f"""(SELECT s_suppkey AS node, population, goods, services, trade, unallocated, modern_share, retail_per_1000, share_urban, urban_status FROM supplier
  LEFT JOIN (SELECT node, avg(value) AS population FROM (__MEAN__) GROUP BY node) ON node = s_suppkey
  LEFT JOIN (SELECT node AS n2, max(share) FILTER ("group" = 'goods') AS goods, max(share) FILTER ("group" = 'services') AS services, max(share) FILTER ("group" = 'trade') AS trade, greatest(1 - sum(share), 0) AS unallocated FROM {rq.BALANCED} GROUP BY node) ON n2 = s_suppkey
  LEFT JOIN (SELECT node AS n3, modern_share, retail_per_1000 FROM (__RETAIL__)) ON n3 = s_suppkey LEFT JOIN (SELECT node AS n4, share_urban, urban_status FROM (__URBAN__)) ON n4 = s_suppkey)"""


def _labour_sql() -> str:
    from .registry import ORACLES

    return _LABOUR.replace("__MEAN__", ORACLES["annual_mean"]).replace("__RETAIL__", ORACLES["retail_objects"]).replace("__URBAN__", ORACLES["urban_share"])


LABOUR_COLUMNS = "population:2 goods services trade unallocated modern_share retail_per_1000 share_urban"


@query(f"SELECT * FROM {_labour_sql()}", LABOUR_COLUMNS)
def labour_table(spark, sf):
    """Every attribute on a spine of all nodes, missing where it is not published."""
    return _labour(spark, sf)


@query(
    f"""WITH t AS (SELECT node, ln(population) - median(ln(population)) OVER () AS level, greatest(goods, 0) + 0.005 AS g, greatest(services, 0) + 0.005 AS s, greatest(trade, 0) + 0.005 AS t, greatest(unallocated, 0) + 0.005 AS u,
      greatest(least(modern_share, quantile_cont(modern_share, 0.99) OVER ()), quantile_cont(modern_share, 0.01) OVER ()) AS modern FROM {_labour_sql()} WHERE population > 0 AND goods IS NOT NULL AND modern_share IS NOT NULL)
    SELECT node, level, ln(g) - (ln(g) + ln(s) + ln(t) + ln(u)) / 4 AS clr_goods, ln(s) - (ln(g) + ln(s) + ln(t) + ln(u)) / 4 AS clr_services, ln(t) - (ln(g) + ln(s) + ln(t) + ln(u)) / 4 AS clr_trade, modern FROM t""",
    "level clr_goods clr_services clr_trade modern",
)
def labour_features(spark, sf):
    """A relative level, log-ratios of sector shares, and a clipped share."""
    t = _labour(spark, sf).where("population > 0 AND goods IS NOT NULL AND modern_share IS NOT NULL")
    z = C.clr(F.array(*[F.greatest(F.col(c), F.lit(0.0)) + 0.005 for c in ("goods", "services", "trade", "unallocated")]))
    bounds = t.agg(F.percentile("modern_share", 0.01).alias("lo"), F.percentile("modern_share", 0.99).alias("hi"))
    t = panel.less_median(t.crossJoin(F.broadcast(bounds)).withColumn("z", z), {"level": F.ln("population")}, [])
    return t.select("node", "level", *[F.col("z")[i].alias(f"clr_{c}") for i, c in enumerate(("goods", "services", "trade"))], C.clip(F.col("modern_share"), F.col("lo"), F.col("hi")).alias("modern"))


# -- P7: profiles of types


@query(
    f"""SELECT node % 4 AS type, median(level) AS level, median(growth) AS growth, median(clr_medium) AS clr_medium, count(*) AS n_nodes, avg((s_acctbal > 5000)::INT) AS share_active, count(DISTINCT s_nationkey) AS n_nations
    FROM {pq._static_sql()} JOIN supplier ON s_suppkey = node GROUP BY 1""",
    "level growth clr_medium share_active",
)
def type_profiles(spark, sf):
    """Medians, sizes and shares of each type."""
    wide = pq.features(spark, sf).join(S.node_region(spark, sf), "node")
    return wide.groupBy((F.col("node") % 4).alias("type")).agg(
        F.median("level").alias("level"), F.median("growth").alias("growth"), F.median("clr_medium").alias("clr_medium"), F.count(F.lit(1)).alias("n_nodes"), F.avg((F.col("s_acctbal") > 5000).cast("int")).alias("share_active"), F.countDistinct("nation").alias("n_nations")
    )


# -- P8: the weight of a constant network term in the assignment of periods


_TERM = "abs(node * 7 % 4 - c.label) / 10.0"


@query(
    f"""WITH v AS {rq._PV}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(e) AS m FROM (SELECT label, unnest(range(1, 8)) AS pos, unnest(x) AS e FROM v) GROUP BY ALL) GROUP BY label),
    a AS (SELECT xi, node, period, arg_min(c.label, (round(1 - list_cosine_similarity(x, c.c) + xi * {_TERM}, 9), c.label)) AS assigned FROM v, c, (VALUES (0.0), (0.5), (1.0), (2.0)) w(xi) GROUP BY ALL)
    SELECT xi, avg((a.assigned = b.assigned)::INT) AS agreement, count(*) AS n FROM a JOIN (SELECT node, period, assigned FROM a WHERE xi = 0) b USING (node, period) GROUP BY xi""",
    "xi agreement",
)
def multiplier_sensitivity(spark, sf):
    """How assignments change with the weight of the network."""
    vectors = rq._period_vectors(spark, sf)
    nodes = vectors.select("node").distinct()
    out, base = None, None
    for xi in (0.0, 0.5, 1.0, 2.0):
        extra = nodes.crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "label"))).withColumn("term", xi * F.abs(F.col("node") * 7 % 4 - F.col("label")) / 10)
        got = dynamics.assign_periods(vectors, extra=extra).select("node", "period", "assigned")
        base = got.withColumnRenamed("assigned", "base") if base is None else base
        part = got.join(base, ["node", "period"]).agg(F.avg((F.col("assigned") == F.col("base")).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n")).withColumn("xi", F.lit(xi))
        out = part if out is None else out.unionByName(part)
    return out


# -- P11: cases


@query(
    f"""WITH f AS (SELECT node, level, node % 4 AS type FROM {pq._static_sql()}), e AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1.0 + (a.s_suppkey + b.s_suppkey) % 3 AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
    m AS (SELECT type, median(level) AS type_median, max_by(node, (level, -node)) AS node FROM f GROUP BY type), n AS (SELECT src AS node, sum(weight * level) FILTER (dst % 5 <> 0) / sum(weight) FILTER (dst % 5 <> 0) AS neighbours FROM e JOIN f ON f.node = dst GROUP BY src)
    SELECT m.type, m.node, level, type_median, neighbours FROM m JOIN f USING (node) LEFT JOIN n USING (node)""",
    "level type_median neighbours",
)
def cases(spark, sf):
    """The extreme node of each type beside its type's median and its neighbours' weighted mean."""
    f = pq.features(spark, sf).select("node", "level", (F.col("node") % 4).alias("type"))
    pairs = pq._pairs(spark, sf).select(F.col("x").alias("a"), F.col("y").alias("b"), (1.0 + (F.col("x") + F.col("y")) % 3).alias("weight"))
    known = f.withColumn("v", F.when(F.col("node") % 5 != 0, F.col("level")))
    near = graph.neighbour_mean(graph.symmetric(pairs), known, "v").withColumnRenamed("neighbour_mean", "neighbours")
    top = f.groupBy("type").agg(F.median("level").alias("type_median"), F.max_by("node", F.struct("level", -F.col("node"))).alias("node"))
    return top.join(f.select("node", "level"), "node").join(near, "node", "left").select("type", "node", "level", "type_median", "neighbours")


# -- P12, P13: windows


@query(
    f"""SELECT t AS variant, label, avg((o0 = o2)::INT) AS stable_share, count(*) AS n FROM (SELECT t, node, max(other) FILTER (period = {pq.FIRST_END}) AS o0, max(other) FILTER (period = {pq.LAST_END}) AS o2, max(label) FILTER (period = {pq.LAST_END}) AS label
    FROM (SELECT t, w.* FROM (SELECT CAST(0.02 AS DOUBLE) AS t UNION ALL SELECT CAST(0.1 AS DOUBLE)) v, LATERAL (SELECT node, period, label, CAST(r > t AS BIGINT) AS other FROM (SELECT node, w_end AS period, r, CAST(r > 0 AS BIGINT) AS label FROM (SELECT node, w_end, avg(r) AS r FROM {pq._res_sql(S.totals_sql('month'))} JOIN {pq.WINDOWS} ON period BETWEEN w_start AND w_end GROUP BY ALL))) w) GROUP BY ALL)
    GROUP BY ALL""",
    "variant stable_share",
)
def window_sensitivity(spark, sf):
    """Of each type, the share that variants of the labelling leave in place between the first and last windows."""
    res, first, last = pq.windowed_residuals(spark, sf)
    level = res.groupBy("node", F.col("w_end").alias("period")).agg(F.avg("r").alias("r"))
    variants = level.crossJoin(F.broadcast(spark.createDataFrame([(0.02,), (0.1,)], "variant double")))
    at = lambda p, c: F.max(F.when(F.col("period") == p, c))
    other = (F.col("r") > F.col("variant")).cast("long")
    ends = variants.groupBy("variant", "node").agg(at(first, other).alias("o0"), at(last, other).alias("o2"), at(last, (F.col("r") > 0).cast("long")).alias("label"))
    return ends.groupBy("variant", "label").agg(F.avg((F.col("o0") == F.col("o2")).cast("int")).alias("stable_share"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH l AS (SELECT node, w_end, CASE WHEN rank() OVER (PARTITION BY w_end ORDER BY r DESC, node) <= 20 THEN 1 END AS top FROM (SELECT node, w_end, round(avg(r), 9) AS r FROM {pq._res_sql(S.totals_sql('month'))} JOIN {pq.WINDOWS} ON period BETWEEN w_start AND w_end GROUP BY ALL)),
    s AS (SELECT w_end, node FROM l WHERE top = 1) SELECT a.w_end AS one, b.w_end AS two, count(*) FILTER (c.node IS NOT NULL) / (40 - count(*) FILTER (c.node IS NOT NULL)) AS jaccard
    FROM (SELECT DISTINCT w_end FROM s) a JOIN (SELECT DISTINCT w_end FROM s) b ON a.w_end < b.w_end JOIN s d ON d.w_end = a.w_end LEFT JOIN s c ON c.w_end = b.w_end AND c.node = d.node GROUP BY ALL""",
    "jaccard",
)
def window_overlap(spark, sf):
    """Overlap of the twenty leading nodes between windows (here sets of nodes instead of edges)."""
    res, first, last = pq.windowed_residuals(spark, sf)
    level = res.groupBy("node", "w_end").agg(F.round(F.avg("r"), 9).alias("r"))
    top = level.withColumn("_p", F.row_number().over(Window.partitionBy("w_end").orderBy(F.col("r").desc(), "node"))).where("_p <= 20")
    ends = top.select("w_end").distinct()
    pairs = ends.withColumnRenamed("w_end", "one").crossJoin(ends.withColumnRenamed("w_end", "two")).where("one < two")
    shared = top.select(F.col("w_end").alias("one"), "node").join(top.select(F.col("w_end").alias("two"), "node"), "node").where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(shared, ["one", "two"], "left").select("one", "two", (F.coalesce("n", F.lit(0)) / (40 - F.coalesce("n", F.lit(0)))).alias("jaccard"))


# -- M12, P14, P15: evaluation of several partitions at once, and of one on several networks


_NETS = {"all": gq.KNN10, "label": gq.LKNN5}


def _mq_sql(edges: str, labels: str) -> str:
    return f"(WITH s AS (SELECT a.label AS la, b.label AS lb, sum(weight) AS w FROM {edges} JOIN {labels} a ON a.node = src JOIN {labels} b ON b.node = dst GROUP BY ALL), r AS (SELECT la, sum(w) AS row, coalesce(sum(w) FILTER (la = lb), 0) AS inn FROM s GROUP BY la) SELECT sum(inn / m - (row / m) * (row / m)) AS mq, avg(inn / row) AS avi FROM r, (SELECT sum(w) AS m FROM s))"


_PARTS = {f"mod{k}": f"(SELECT vec_id AS node, CAST(label % {k} AS BIGINT) AS label FROM embeddings)" for k in (2, 3, 5)}


@query(" UNION ALL ".join(f"SELECT '{p}' AS candidate, '{n}' AS network, mq, avi FROM {_mq_sql(e, t)}" for p, t in _PARTS.items() for n, e in _NETS.items()), "mq avi")
def evaluate_candidates(spark, sf):
    """Candidates in one long table, so a network is joined once for all of them."""
    base = gq.labels(spark, sf)
    long = reduce(lambda a, b: a.unionByName(b), [base.select(F.lit(f"mod{k}").alias("candidate"), "node", (F.col("label") % k).alias("label")) for k in (2, 3, 5)])
    out = None
    for name, edges in (("all", gq.knn(spark, sf)), ("label", gq.knn(spark, sf, 5, True))):
        one = edges.join(long.select(F.col("node").alias("src"), "candidate", F.col("label").alias("la")), "src").groupBy("candidate", "la", "dst").agg(F.sum("weight").alias("weight"))
        s = one.join(long.select("candidate", F.col("node").alias("dst"), F.col("label").alias("lb")), ["candidate", "dst"]).groupBy("candidate", "la", "lb").agg(F.sum("weight").alias("w"))
        r = s.groupBy("candidate", "la").agg(F.sum("w").alias("row"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inn"))
        m = F.sum("row").over(Window.partitionBy("candidate"))
        part = r.withColumn("m", m).groupBy("candidate").agg(F.sum(F.col("inn") / F.col("m") - (F.col("row") / F.col("m")) ** 2).alias("mq"), F.avg(F.col("inn") / F.col("row")).alias("avi")).withColumn("network", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH a AS {gq.KNN10}, b AS {gq.LKNN5}, w AS (SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, weight / (SELECT sum(weight) FROM a) AS w FROM a UNION ALL SELECT src, dst, weight / (SELECT sum(weight) FROM b) FROM b) GROUP BY ALL)
    SELECT 'equal mass' AS variant, mq, avi FROM {_mq_sql('w', gq.LABELS)} UNION ALL SELECT 'without label', mq, avi FROM {_mq_sql('a', gq.LABELS)} UNION ALL SELECT 'without all', mq, avi FROM {_mq_sql('b', gq.LABELS)}""",
    "mq avi",
)
def layer_sensitivity(spark, sf):
    """A partition on the multiplex of equal masses and with each layer dropped."""
    a, b, labels = gq.knn(spark, sf), gq.knn(spark, sf, 5, True), gq.labels(spark, sf)
    variants = {"equal mass": graph.multiplex([(a, 1.0), (b, 1.0)], equal_mass=True), "without label": a, "without all": b}
    out = None
    for name, edges in variants.items():
        part = indices.network_indices(edges, labels).select(F.lit(name).alias("variant"), "mq", "avi")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SELECT CAST(label % 3 AS BIGINT) AS a, CAST(label % 4 AS BIGINT) AS b, count(*) AS n FROM embeddings GROUP BY ALL HAVING count(*) > 0"
)
def finalist_crosstab(spark, sf):
    """How two finalists divide the nodes, long and without empty cells."""
    both = gq.labels(spark, sf).select((F.col("label") % 3).alias("a"), (F.col("label") % 4).alias("b"))
    wide = both.groupBy("a").pivot("b", [0, 1, 2, 3]).count()
    return wide.unpivot(["a"], ["0", "1", "2", "3"], "b", "n").where("n > 0").select("a", F.col("b").cast("long").alias("b"), "n")


@query(
    "WITH t AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS y, doc_id % 6 AS k6, doc_id % 7 AS k7, doc_id % 8 AS k8 FROM documents), u AS (UNPIVOT t ON k6, k7, k8 INTO NAME k VALUE g), m AS (SELECT k, g, avg(y) AS m, count(*) AS n, var_pop(y) AS s FROM u GROUP BY ALL) "
    "SELECT k, sum(n * (m - gm) ** 2) / sum(n * ((m - gm) ** 2 + s)) AS eta2, CAST(sum(n) AS BIGINT) AS n FROM m, (SELECT avg(y) AS gm FROM t) GROUP BY k",
    "eta2",
)
def k_choice(spark, sf):
    """Explained variance for several numbers of types, in one pass."""
    t = S.load(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("y"), *[(F.col("doc_id") % k).alias(f"k{k}") for k in (6, 7, 8)])
    return validation.eta_squared(t.unpivot(["doc_id", "y"], ["k6", "k7", "k8"], "k", "g"), "g", "y", ["k"])


@query(
    f"""WITH u AS (SELECT node, y, period, category, (d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w * sqrt(count(d) OVER w), 0) AS u FROM (SELECT node, period // 4 AS y, period % 4 AS period, category, r - avg(r) OVER (PARTITION BY node, period // 4, category) AS d
      FROM (SELECT *, ln(value) - median(ln(value)) OVER (PARTITION BY period, category) AS r FROM {S.cells_sql('quarter')})) WINDOW w AS (PARTITION BY node, y))
    SELECT CAST(a.y AS BIGINT) AS year, a.node AS src, b.node AS dst, greatest(sum(a.u * b.u), 0) AS weight FROM u a JOIN u b ON a.y = b.y AND a.period = b.period AND a.category = b.category AND a.node < b.node GROUP BY ALL HAVING weight > 0""",
    "weight",
)
def yearly_comovement(spark, sf):
    """Similarity of trajectories year by year."""
    # medians, the list of cells and the sizes of blocks read the cells again: they are summed once
    res = panel.residuals(checkpointed(S.cells(spark, sf, "quarter")), ["period", "category"]).withColumn("year", F.expr("period div 4"))
    keyed = res.withColumn("key", F.struct("node", "year")).drop("node").withColumnRenamed("key", "node")
    rows = panel.standard_rows(keyed).select(F.col("node.node").alias("node"), F.col("node.year").alias("year"), "category", "period", "u")
    return panel.comovement(rows, ["year"]).where("weight > 0")


@query(
    f"SELECT a.candidate, a.borda_place, o.without, o.place FROM (SELECT candidate, rank() OVER (ORDER BY borda DESC) AS borda_place FROM {gq.BORDA}) a JOIN (SELECT 'size' AS without, candidate, rank() OVER (ORDER BY sum(25 - place) DESC) AS place FROM {gq.RANKS} WHERE index <> 'size' GROUP BY candidate) o USING (candidate) WHERE borda_place <= 12"
)
def top_candidates(spark, sf):
    """the leading candidates beside their places without one index (a top-k report)."""
    table = gq.ranks(spark, sf)
    place = lambda df, name: df.select("candidate", F.rank().over(Window.orderBy(F.col("borda").desc())).alias(name))
    head = place(ranking.borda(table), "borda_place").where("borda_place <= 12")
    other = place(ranking.borda(table.where(F.col("index") != "size")), "place").withColumn("without", F.lit("size"))
    return head.join(other, "candidate").select("candidate", "borda_place", "without", "place")


# -- scans and scalar functions


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40", "l_quantity")
def projected_scan(spark, sf):
    """A2: three columns and a predicate that both reach the Parquet reader."""
    from ..sources import storage

    return storage.projected(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))


@query("SELECT p_partkey AS node, p_retailprice AS access FROM part", "access")
def scalar_lookup(spark, sf):
    """A3: one number a node."""
    return S.load(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("access"))


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS log_balance, ln(1 + abs(c_acctbal)) AS log1p_balance, exp(c_acctbal / 10000) AS growth, sqrt(abs(c_acctbal)) AS root, round(c_acctbal, 1) AS tenth FROM customer",
    "log_balance log1p_balance growth root tenth",
)
def scalar_functions(spark, sf):
    """H1: logarithms of what has one, and the rest."""
    b = F.col("c_acctbal")
    return S.load(spark, sf, "customer").select("c_custkey", C.safe_ln(b).alias("log_balance"), F.log1p(F.abs(b)).alias("log1p_balance"), F.exp(b / 10000).alias("growth"), F.sqrt(F.abs(b)).alias("root"), F.round(b, 1).alias("tenth"))


@query(
    f"""WITH v AS (SELECT node, [{', '.join(pq.LOWER)}] AS x FROM (SELECT node, {', '.join(f'avg({c}) AS {c}' for c in pq.LOWER)} FROM {pq._shares_sql(pq.YEAR)} GROUP BY node))
    SELECT a.node AS a, b.node AS b, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS squared, list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) AS manhattan,
    list_sum(list_transform(list_zip(a.x, b.x), lambda z: (round(z[1], 2) <> round(z[2], 2))::DOUBLE)) AS hamming, (1 + list_cosine_similarity(a.x, b.x)) / 2 AS cosine FROM v a JOIN v b ON b.node = a.node + 1""",
    "squared manhattan hamming cosine",
)
def vector_distances(spark, sf):
    """Distances of neighbouring nodes' share vectors."""
    v = panel.share_vectors(panel.shares(S.cells(spark, sf), S.NAMED, S.RESIDUAL), pq.CATS, ["node"])
    other = v.select((F.col("node") - 1).alias("node"), F.col("node").alias("b"), F.col("shares").alias("y"))
    both = v.join(other, "node")
    cut = lambda c: F.transform(c, lambda e: F.round(e, 2))
    return both.select(F.col("node").alias("a"), "b", C.squared_distance(F.col("shares"), F.col("y")).alias("squared"), C.manhattan(F.col("shares"), F.col("y")).alias("manhattan"), C.hamming(cut("shares"), cut("y")).alias("hamming"), C.cosine_similarity(F.col("shares"), F.col("y")).alias("cosine"))


@query(
    "WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_totalprice FROM orders) SELECT * FROM t WHERE place <= 20", "o_totalprice"
)
def top_orders(spark, sf):
    """a top-k report; the limit is applied in every partition before one merges them."""
    head = S.load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
    return head.withColumn("place", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))
