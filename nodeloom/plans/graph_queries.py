"""Queries on graphs, quality indices, rank aggregation and agreement of partitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, indices, ranking, selection, validation
from ..sources import standins as S
from ..sources import storage
from .registry import query

V = "(SELECT vec_id AS node, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"
COS = f"(SELECT a.node AS src, b.node AS dst, (1 + list_dot_product(a.x, b.x) / (greatest(a.n, 1e-12) * greatest(b.n, 1e-12))) / 2 AS weight FROM {V} a JOIN {V} b ON a.node <> b.node)"
LCOS = COS.replace("ON a.node <> b.node", "ON a.node <> b.node AND a.label = b.label")
TOP = "(SELECT * FROM {s} QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) <= {k} AND weight > 0)"
KNN = "(SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM {t} UNION ALL SELECT dst, src, weight FROM {t}) GROUP BY ALL)"
KNN10 = KNN.format(t=TOP.format(s=COS, k=10))
LKNN5 = KNN.format(t=TOP.format(s=LCOS, k=5))
LABELS = "(SELECT vec_id AS node, CAST(label AS BIGINT) AS label FROM embeddings)"
FIRST = "(SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)"


def knn(spark, sf, k=10, within=False):
    return graph.knn_graph(S.vectors(spark, sf), k, ["label"] if within else None)


def labels(spark, sf):
    return S.vectors(spark, sf).select("node", "label")


def first(spark, sf):
    return S.vectors(spark, sf).select("node", F.col("x")[0].alias("v"))


@query(f"SELECT * FROM {KNN10}", "weight")
def cosine_knn(spark, sf):
    """Nearest others by cosine, symmetrised by the larger weight."""
    return knn(spark, sf)


@query(f"WITH t AS {TOP.format(s=COS, k=10)} SELECT a.src, a.dst, least(a.weight, b.weight) AS weight FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src", "weight")
def mutual_knn(spark, sf):
    return graph.knn_graph(S.vectors(spark, sf), 10, mutual=True)


FLOWS = """(SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, abs(c_nationkey * 7 - s_nationkey * 3) % 11 * 25.0 + l_linenumber AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
CANON = f"""(SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN avg(d) <= 1.5 THEN 1.0 ELSE avg(d) END AS distance, max(d) - min(d) AS spread FROM {FLOWS} WHERE a <> b GROUP BY 1, 2)"""


def _flows(spark, sf):
    items = S.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_linenumber")
    orders = S.load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = S.load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    suppliers = S.load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    distance = F.abs(F.col("a") * 7 - F.col("b") * 3) % 11 * 25.0 + F.col("l_linenumber")
    return items.join(orders, "o_orderkey").join(customers, "c_custkey").join(suppliers, "s_suppkey").select("a", "b", distance.alias("d"))


@query(f"SELECT * FROM {CANON}", "distance spread")
def canonical_pairs(spark, sf):
    """K1: both directions averaged, self pairs dropped, distances not above zero replaced."""
    pairs = graph.canonical_pairs(_flows(spark, sf), "a", "b", "d")
    return pairs.withColumn("distance", F.when(F.col("distance") <= 1.5, 1.0).otherwise(F.col("distance")))


@query(f"SELECT a AS src, b AS dst, exp(-distance / 150) AS weight FROM {CANON} WHERE a % 2 = 0 AND b % 2 = 0 UNION ALL SELECT b, a, exp(-distance / 150) FROM {CANON} WHERE a % 2 = 0 AND b % 2 = 0", "weight")
def geography_similarity(spark, sf):
    """A kernel of distances on the subgraph of even nodes."""
    nodes = S.load(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.restrict(graph.kernel(canonical_pairs(spark, sf)), nodes)


@query(
    f"""WITH a AS {KNN10}, b AS {LKNN5} SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, weight / (SELECT avg(weight) FROM a) AS w FROM a
    UNION ALL SELECT src, dst, 0.5 * weight / (SELECT avg(weight) FROM b) FROM b) GROUP BY ALL""",
    "weight",
)
def multiplex_edges(spark, sf):
    """K4, K5: two layers over their mean weights, the second at half weight."""
    return graph.multiplex([(knn(spark, sf), 1.0), (knn(spark, sf, 5, True), 0.5)])


@query(
    f"""WITH a AS {KNN10}, b AS {LKNN5}, m AS (SELECT 'all' AS layer, sum(weight) / avg(weight) AS mass FROM a UNION ALL SELECT 'label', sum(weight) / avg(weight) FROM b)
    SELECT layer, mass / (SELECT sum(mass) FROM m) AS share FROM m""",
    "share",
)
def layer_masses(spark, sf):
    """K6: each layer's share of the multiplex."""
    return graph.layer_masses({"all": knn(spark, sf), "label": knn(spark, sf, 5, True)})


@query(
    f"""WITH a AS (SELECT src, dst FROM {KNN10} WHERE src < dst), b AS (SELECT src, dst FROM {LKNN5} WHERE src < dst), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
    SELECT (SELECT count(*) FROM i) AS n_both, (SELECT count(*) FROM u) AS n_any, (SELECT count(*) FROM i) / (SELECT count(*) FROM u) AS jaccard""",
    "jaccard",
)
def edge_jaccard(spark, sf):
    return graph.edge_jaccard(knn(spark, sf), knn(spark, sf, 5, True))


SPARSE = f"(SELECT * FROM {LKNN5} WHERE weight > 0.64)"


def sparse(spark, sf):
    return knn(spark, sf, 5, True).where("weight > 0.64")


@query(
    f"""WITH e AS {SPARSE}, d AS (SELECT node, count(src) AS d FROM {LABELS} LEFT JOIN e ON src = node GROUP BY node)
    SELECT count(*) AS n_nodes, CAST(sum(d) // 2 AS BIGINT) AS n_edges, avg(d) AS mean_degree, count(*) FILTER (d = 0) AS isolated FROM d""",
    "mean_degree",
)
def graph_degree_summary(spark, sf):
    return graph.summary(sparse(spark, sf), labels(spark, sf))


REACH = f"WITH RECURSIVE e AS MATERIALIZED {SPARSE}, r(node, seen) AS (SELECT node, node FROM {LABELS} UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen)"


@query(f"{REACH} SELECT node, min(seen) AS component FROM r GROUP BY node")
def components(spark, sf):
    """K8: the least node reachable, by rounds of label passing."""
    return graph.components(sparse(spark, sf), labels(spark, sf).select("node"))


@query(
    f"""{REACH}, c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), s AS (SELECT label, component, count(*) AS size FROM c JOIN {LABELS} USING (node) GROUP BY ALL)
    SELECT label, CAST(sum(size) AS BIGINT) AS n_nodes, count(*) AS n_components, max(size) / sum(size) AS largest_share FROM s GROUP BY label""",
    "largest_share",
)
def type_components(spark, sf):
    """K9: components inside each label (these edges never leave a label)."""
    return graph.type_components(sparse(spark, sf), labels(spark, sf))


LAG = f"""(WITH e AS {KNN10}, s AS (SELECT * FROM {FIRST} WHERE node IN (SELECT src FROM e)), z AS (SELECT node, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM s)
  SELECT z.node, z.z, l.lag, z.z * l.lag AS local FROM z JOIN (SELECT src AS node, sum(weight * z) / sum(weight) AS lag FROM e JOIN z ON dst = node GROUP BY src) l USING (node))"""


@query(f"SELECT sum(local) / sum(z * z) AS i, count(*) AS n FROM {LAG}", "i")
def morans_i(spark, sf):
    return graph.morans_i(knn(spark, sf), first(spark, sf), "v")


@query(f"SELECT *, CASE WHEN z > 0 THEN 'H' ELSE 'L' END || CASE WHEN lag > 0 THEN 'H' ELSE 'L' END AS quadrant FROM {LAG}", "z lag local")
def local_moran_quadrant(spark, sf):
    """Local products and quadrants."""
    return graph.quadrants(knn(spark, sf), first(spark, sf), "v")


@query(
    f"""WITH e AS {LKNN5}, k AS (SELECT src AS node, sum(weight) AS k FROM e GROUP BY 1) SELECT src, dst, weight - a.k * b.k / (SELECT sum(weight) FROM e) AS b
    FROM e JOIN k a ON a.node = src JOIN k b ON b.node = dst""",
    "b",
)
def modularity_cells(spark, sf):
    return graph.modularity_cells(knn(spark, sf, 5, True))


BETWEEN = f"(SELECT a.label AS la, b.label AS lb, sum(weight) AS weight FROM {KNN10} JOIN {LABELS} a ON a.node = src JOIN {LABELS} b ON b.node = dst GROUP BY ALL)"


@query(f"SELECT * FROM {BETWEEN}", "weight")
def cluster_edge_weights(spark, sf):
    return indices.between_weights(knn(spark, sf), labels(spark, sf))


NETWORK = f"""WITH s AS {BETWEEN}, r AS (SELECT la, sum(weight) AS row, sum(weight) FILTER (la = lb) AS inn FROM s GROUP BY la), c AS (SELECT lb, sum(weight) AS col, sum(weight) FILTER (la = lb) AS inb FROM s GROUP BY lb)
    SELECT (SELECT avg(coalesce(inn, 0) / row) FROM r) AS avi, (SELECT sum(weight / (row - coalesce(inn, 0) + col - coalesce(inb, 0) - weight)) FROM s JOIN r USING (la) JOIN c USING (lb) WHERE la <> lb) / (SELECT count(DISTINCT label) FROM {LABELS}) AS avu,
    (SELECT sum(coalesce(inn, 0) / m - (row / m) * (row / m)) FROM r, (SELECT sum(weight) AS m FROM s)) AS mq"""


@query(NETWORK, "avi avu mq")
def avi_avu_mq(spark, sf):
    return indices.network_indices(knn(spark, sf), labels(spark, sf))


@query("SELECT count(*) AS k, min(n) AS min_size, max(n) / sum(n) AS max_share FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)", "max_share")
def cluster_sizes(spark, sf):
    return indices.sizes(labels(spark, sf))


@query("SELECT node, CAST(new AS BIGINT) AS label FROM " + LABELS + " JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new FROM embeddings GROUP BY label) USING (label)")
def relabel_by_size(spark, sf):
    return indices.renumbered(labels(spark, sf))


SILHOUETTE = f"""WITH d AS (SELECT a.node, a.label, b.label AS ol, avg(list_distance(a.x, b.x)) AS d FROM {V} a JOIN {V} b ON a.node <> b.node GROUP BY ALL),
    ab AS (SELECT node, label, max(d) FILTER (label = ol) AS a, min(d) FILTER (label <> ol) AS b FROM d GROUP BY ALL)
    SELECT label, avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS sw, count(*) AS n FROM ab GROUP BY label"""


@query(SILHOUETTE, "sw")
def silhouette_by_label(spark, sf):
    return indices.silhouette(S.vectors(spark, sf)).groupBy("label").agg(F.avg("sw").alias("sw"), F.count(F.lit(1)).alias("n"))


CELLS = f"(SELECT node, label, unnest(range(1, 65)) AS pos, unnest(x) AS v FROM {V})"


CH = f"""WITH c AS {CELLS}, g AS (SELECT pos, avg(v) AS g FROM c GROUP BY pos), m AS (SELECT label, pos, avg(v) AS m, count(*) AS n, var_pop(v) AS s FROM c GROUP BY ALL)
    SELECT (sum(n * (m - g) * (m - g)) / (count(DISTINCT label) - 1)) / (sum(n * s) / (sum(n) / 64 - count(DISTINCT label))) AS ch FROM m JOIN g USING (pos)"""


@query(CH, "ch")
def calinski_harabasz(spark, sf):
    return indices.calinski_harabasz(S.vectors(spark, sf))


SDBW = f"""WITH c AS {CELLS}, p AS (SELECT label, pos, avg(v) AS m, var_pop(v) AS s FROM c GROUP BY ALL), k AS (SELECT label, list(m ORDER BY pos) AS c, sqrt(sum(s * s)) AS sp FROM p GROUP BY label),
    st AS (SELECT avg(sp) AS sig, sqrt(sum(sp)) / count(*) AS rad, count(*) AS k FROM k), al AS (SELECT sqrt(sum(s * s)) AS a FROM (SELECT var_pop(v) AS s FROM c GROUP BY pos)),
    pr AS (SELECT a.label AS la, b.label AS lb, a.c AS ca, b.c AS cb, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) / 2) AS cm FROM k a JOIN k b ON a.label < b.label),
    d AS (SELECT la, lb, count(*) FILTER (list_distance(x, ca) <= rad) AS na, count(*) FILTER (list_distance(x, cb) <= rad) AS nb, count(*) FILTER (list_distance(x, cm) <= rad) AS nm
      FROM pr JOIN {V} v ON v.label IN (la, lb), st GROUP BY ALL)
    SELECT (SELECT sig FROM st) / (SELECT a FROM al) + (SELECT 2 * sum(coalesce(nm / nullif(greatest(na, nb), 0), 0)) FROM d) / (SELECT k * (k - 1) FROM st) AS s_dbw"""


@query(SDBW, "s_dbw")
def s_dbw(spark, sf):
    return indices.s_dbw(S.vectors(spark, sf))


BRANDS = """(SELECT p_brand AS candidate, avg(p_retailprice) AS price, avg(CAST(p_size AS DOUBLE)) AS size, CAST(count(*) AS DOUBLE) AS parts, CAST(count(DISTINCT p_type) AS DOUBLE) AS types FROM part GROUP BY 1)"""
LONG = f"(UNPIVOT {BRANDS} ON price, size, parts, types INTO NAME index VALUE value)"
RANKS = f"""(SELECT candidate, index, value, rank() OVER w + (count(*) OVER (PARTITION BY index, value) - 1) / 2.0 AS place
  FROM (SELECT candidate, index, round(value, 9) AS value FROM {LONG}) WINDOW w AS (PARTITION BY index ORDER BY CASE WHEN index = 'size' THEN -value ELSE value END DESC))"""
DIRECTIONS = {"price": 1, "size": -1, "parts": 1, "types": 1}


def ranks(spark, sf):
    brands = S.load(spark, sf, "part").groupBy(F.col("p_brand").alias("candidate")).agg(
        F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"), F.count(F.lit(1)).cast("double").alias("parts"), F.countDistinct("p_type").cast("double").alias("types")
    )
    return ranking.rank_table(brands.unpivot(["candidate"], list(DIRECTIONS), "index", "value").withColumn("value", F.round("value", 9)), DIRECTIONS)


@query(f"SELECT * FROM {RANKS}", "value place")
def rank_indices(spark, sf):
    """Average ranks of each index, in its direction."""
    return ranks(spark, sf)


BORDA = f"(SELECT candidate, sum(n - place) AS borda FROM (SELECT *, count(*) OVER (PARTITION BY index) AS n FROM {RANKS}) GROUP BY candidate)"
COPE = f"(SELECT candidate, CAST(sum(sign(won)) AS BIGINT) AS copeland FROM (SELECT a.candidate, b.candidate AS o, sum(sign(b.place - a.place)) AS won FROM {RANKS} a JOIN {RANKS} b USING (index) GROUP BY ALL) GROUP BY candidate)"


@query(f"SELECT * FROM {BORDA}", "borda")
def borda(spark, sf):
    return ranking.borda(ranks(spark, sf))


@query(f"SELECT candidate, sum((n - place) * CASE WHEN index IN ('parts', 'types') THEN 0.5 ELSE 1 END) AS borda FROM (SELECT *, count(*) OVER (PARTITION BY index) AS n FROM {RANKS}) GROUP BY candidate", "borda")
def weighted_borda(spark, sf):
    """Two kindred indices at half weight."""
    return ranking.borda(ranks(spark, sf), {"parts": 0.5, "types": 0.5})


@query(f"SELECT * FROM {COPE}")
def copeland(spark, sf):
    return ranking.copeland(ranks(spark, sf))


@query(f"SELECT *, rank() OVER (ORDER BY borda DESC) AS borda_place, rank() OVER (ORDER BY copeland DESC) AS copeland_place FROM {BORDA} JOIN {COPE} USING (candidate)", "borda")
def rank_aggregate(spark, sf):
    """Both scores with their places."""
    return ranking.aggregate(ranks(spark, sf))


@query(f"SELECT 12 * sum((t - 4 * (n + 1) / 2.0) ** 2) / (16 * (max(n) ** 3 - max(n))) AS w FROM (SELECT candidate, sum(place) AS t, count(*) OVER () AS n FROM {RANKS} GROUP BY candidate)", "w")
def kendall_w(spark, sf):
    return ranking.kendall_w(ranks(spark, sf))


@query(
    f"""WITH full_rank AS (SELECT candidate, rank() OVER (ORDER BY borda DESC) AS place FROM {BORDA}), dropped AS (SELECT d.index AS without, candidate, sum(25 - place) AS b FROM {RANKS} r JOIN (SELECT DISTINCT index FROM {LONG}) d ON r.index <> d.index GROUP BY ALL),
    p AS (SELECT without, candidate, rank() OVER (PARTITION BY without ORDER BY b DESC) AS place FROM dropped) SELECT without, candidate, p.place AS place, CAST(p.place - f.place AS BIGINT) AS moved FROM p JOIN full_rank f USING (candidate)"""
)
def rule_sensitivity(spark, sf):
    """Places when one index is left out."""
    table = ranks(spark, sf)
    base = ranking.borda(table).select("candidate", F.rank().over(Window.orderBy(F.col("borda").desc())).alias("_f"))
    out = None
    for name in DIRECTIONS:
        part = ranking.borda(table.where(F.col("index") != name)).select(F.lit(name).alias("without"), "candidate", F.rank().over(Window.orderBy(F.col("borda").desc())).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out.join(base, "candidate").select("without", "candidate", "place", (F.col("place") - F.col("_f")).cast("long").alias("moved"))


ADMIT = "(SELECT p_brand AS candidate, p_type, count(*) AS size FROM part GROUP BY ALL)"


@query(f"SELECT candidate, count(*) AS k, min(size) AS min_size, max(size) / 80 AS max_share FROM {ADMIT} GROUP BY candidate HAVING min(size) >= 4 AND max(size) <= 32", "max_share")
def admissible(spark, sf):
    """Candidates with no cluster too small or too large."""
    sizes = S.load(spark, sf, "part").groupBy(F.col("p_brand").alias("candidate"), "p_type").agg(F.count(F.lit(1)).alias("size"))
    return ranking.admissible(sizes, 80, 0.05, 0.4)


@query(
    f"""SELECT candidate, borda, stability FROM (SELECT candidate, borda, 0.5 + (hash_ % 7) / 20.0 AS stability, rank() OVER (ORDER BY borda DESC) AS place FROM {BORDA} JOIN
    (SELECT p_brand AS candidate, sum(p_size) AS hash_ FROM part GROUP BY 1) USING (candidate)) WHERE stability >= 0.6 ORDER BY place, candidate LIMIT 1""",
    "borda stability",
)
def choose_stable(spark, sf):
    """The best candidate among the stable ones."""
    stability = S.load(spark, sf, "part").groupBy(F.col("p_brand").alias("candidate")).agg((0.5 + F.sum("p_size") % 7 / 20).alias("stability"))
    return ranking.choose(ranking.aggregate(ranks(spark, sf)), stability, 0.6).select("candidate", "borda", "stability")


@query(
    """WITH k AS (SELECT unnest(range(4, 13)) AS k), net AS (SELECT unnest(['geography', 'comovement', 'leadlag', 'multiplex']) AS n) SELECT m || '|k' || k AS candidate FROM (SELECT unnest(['kmeans', 'gmm', 'ward', 'pattern']) AS m), k
    UNION ALL SELECT 'leiden|' || n || '|r' || r FROM net, (SELECT unnest(['0.02', '0.05', '0.1', '0.2', '0.3', '0.5', '1.0']) AS r) UNION ALL SELECT m || '|' || n || '|k' || k FROM (SELECT unnest(['spectral', 'spectral_joint']) AS m), net, k
    UNION ALL SELECT 'kefrin|' || n || '|k' || k || '|' || d FROM net, k, (SELECT unnest(['cosine|x1.0', 'cosine|x4.0', 'cosine|x16.0', 'euclidean|x1.0']) AS d)"""
)
def candidate_grid(spark, sf):
    """The whole grid of 280 candidates, from its parameter tables."""
    found = selection.grid(spark, list(range(4, 13)), ["geography", "comovement", "leadlag", "multiplex"], [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0], ["cosine", "euclidean"], [1.0, 4.0, 16.0])
    return found.select("candidate")


def _indices_sql(k: int) -> str:
    """All indices of the partition by label modulo k."""
    one = lambda sql: sql.replace("CAST(label AS BIGINT) AS label", f"CAST(label % {k} AS BIGINT) AS label")
    sw = f"SELECT sum(sw * n) / sum(n) AS sw FROM ({one(SILHOUETTE)})"
    sizes = f"SELECT count(*) AS k, min(n) AS min_size, max(n) / sum(n) AS max_share FROM (SELECT label % {k} AS l, count(*) AS n FROM embeddings GROUP BY 1)"
    return f"SELECT 'mod{k}' AS candidate, * FROM ({sw}), ({one(CH)}), ({one(SDBW)}), ({one(NETWORK)}), ({sizes})"


def _given(spark, sf):
    base = labels(spark, sf)
    parts = [base.select(F.lit(f"mod{k}").alias("candidate"), "node", (F.col("label") % k).alias("label")) for k in (2, 3, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" UNION ALL ".join(_indices_sql(k) for k in (2, 3, 5)), "sw ch s_dbw avi avu mq max_share")
def candidate_indices(spark, sf):
    """Six indices and sizes of several given partitions at once."""
    return selection.evaluate(_given(spark, sf), S.vectors(spark, sf), knn(spark, sf))


@query(
    f"""WITH i AS ({" UNION ALL ".join(_indices_sql(k) for k in (2, 3, 5))}), l AS (UNPIVOT (SELECT candidate, sw, ch, s_dbw, avi, avu, mq FROM i WHERE min_size >= 0.01 * (SELECT count(*) FROM embeddings) AND max_share <= 0.6) ON sw, ch, s_dbw, avi, avu, mq INTO NAME index VALUE v),
    r AS (SELECT candidate, index, rank() OVER w + (count(*) OVER (PARTITION BY index, round(v, 9)) - 1) / 2.0 AS place, count(*) OVER (PARTITION BY index) AS n FROM l WINDOW w AS (PARTITION BY index ORDER BY CASE WHEN index IN ('s_dbw', 'avu') THEN -round(v, 9) ELSE round(v, 9) END DESC))
    SELECT candidate, sum(n - place) AS borda, rank() OVER (ORDER BY sum(n - place) DESC) AS borda_place FROM r GROUP BY candidate""",
    "borda",
)
def rank_partitions(spark, sf):
    """Admissible partitions by Borda over the six indices."""
    vectors = S.vectors(spark, sf)
    table = storage.checkpointed(selection.evaluate(_given(spark, sf), vectors, knn(spark, sf)))
    return selection.ranked(table, vectors.count(), 24).select("candidate", "borda", "borda_place")


OUTCOME = "(SELECT l.doc_id, quality, toxic, source, lang, CAST(n_chars AS DOUBLE) AS n_chars FROM labels l JOIN documents USING (doc_id))"


def outcome(spark, sf):
    return S.load(spark, sf, "labels").join(S.load(spark, sf, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double")), "doc_id")


@query(
    f"""WITH t AS (SELECT quality AS a, lang AS b, count(*) AS n FROM {OUTCOME} GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS ab, sum(n) AS tot FROM t),
    a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM t GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM t GROUP BY b))
    SELECT (ab - a * b / (tot * (tot - 1) / 2)) / ((a + b) / 2 - a * b / (tot * (tot - 1) / 2)) AS ari FROM x, a, b""",
    "ari",
)
def ari_partitions(spark, sf):
    return validation.adjusted_rand(outcome(spark, sf), "quality", "lang")


@query()
def ami_partitions(spark, sf):
    """Adjusted mutual information, on the contingency table."""
    value = validation.adjusted_mutual_information(outcome(spark, sf), "quality", "lang")
    return spark.createDataFrame([(value,)], "ami double")


ETA = "(SELECT {g} AS g, avg({v}) AS m, count(*) AS n, var_pop({v}) AS s FROM {t} GROUP BY 1)"


def _eta_sql(t: str, g: str, v: str) -> str:
    return f"SELECT sum(n * (m - gm) ** 2) / sum(n * ((m - gm) ** 2 + s)) AS eta2, CAST(sum(n) AS BIGINT) AS n FROM {ETA.format(t=t, g=g, v=v)}, (SELECT avg({v}) AS gm FROM {t})"


@query(_eta_sql("customer", "c_mktsegment", "c_acctbal"), "eta2")
def eta_squared(spark, sf):
    return validation.eta_squared(S.load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


KRUSKAL = """(WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer),
  t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM customer GROUP BY c_acctbal)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer)
  SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, df FROM (SELECT sum(q) AS s, count(*) - 1 AS df FROM (SELECT g, sum(r) ** 2 / count(*) AS q FROM r GROUP BY g)), t, n)"""


@query(f"SELECT * FROM {KRUSKAL}", "h")
def kruskal_h(spark, sf):
    return validation.kruskal_h(S.load(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


CRAMER = """(WITH t AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {f} GROUP BY ALL), r AS (SELECT a, sum(n) AS ra FROM t GROUP BY a), c AS (SELECT b, sum(n) AS rb FROM t GROUP BY b), x AS (SELECT sum(n) AS tot FROM t),
  e AS (SELECT coalesce(n, 0) AS n, ra * rb / tot AS e, tot FROM r CROSS JOIN c CROSS JOIN x LEFT JOIN t USING (a, b))
  SELECT sum((n - e) ** 2 / e) AS chi2, sqrt(sum((n - e) ** 2 / e) / (max(tot) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1))) AS v, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS df FROM e)"""


@query(f"SELECT * FROM {CRAMER.format(a='o_orderpriority', b='o_orderstatus', f='orders')}", "chi2 v")
def cramers_v(spark, sf):
    return validation.cramers_v(S.load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    f"SELECT 'n_chars' AS variable, 'eta2' AS kind, eta2 AS strength FROM ({_eta_sql(OUTCOME, 'quality', 'n_chars')}) UNION ALL SELECT 'lang', 'v', v FROM {CRAMER.format(a='quality', b='lang', f=OUTCOME)}", "strength"
)
def external_table(spark, sf):
    """A partition against a number and a category."""
    return validation.external_table(outcome(spark, sf), "quality", ["n_chars"], ["lang"])


P = "(SELECT s_suppkey AS key, (s_suppkey * 37 % 101 + 1) / 1000.0 + s_suppkey / 1e6 AS p FROM supplier)"


def _q_sql(factor: str) -> str:
    return f"""SELECT key, p, least(min(raw) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM (SELECT *, p * n * {factor} / r AS raw FROM
      (SELECT key, p, row_number() OVER (ORDER BY p, key) AS r, count(*) OVER () AS n FROM {P}))"""


@query(_q_sql("1"), "p q")
def bh_qvalues(spark, sf):
    tests = S.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), ((F.col("s_suppkey") * 37 % 101 + 1) / 1000 + F.col("s_suppkey") / 1e6).alias("p"))
    return validation.q_values(tests, "key", "p")


@query(_q_sql("(SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) FROM supplier) + 1) t(i))"), "p q")
def by_qvalues(spark, sf):
    tests = S.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), ((F.col("s_suppkey") * 37 % 101 + 1) / 1000 + F.col("s_suppkey") / 1e6).alias("p"))
    return validation.q_values(tests, "key", "p", dependent=True)


@query(
    """WITH c AS (SELECT list_distinct([quantile_cont(p_retailprice, i / 8.0) FOR i IN range(1, 8)]) AS cuts FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, CAST(len(list_filter(cuts, lambda x: x <= p_retailprice)) AS BIGINT) AS octile FROM part, c WHERE p_partkey % 5 = 0""".replace(
        "[quantile_cont(p_retailprice, i / 8.0) FOR i IN range(1, 8)]", "quantile_cont(p_retailprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])"
    )
)
def octiles(spark, sf):
    part = S.load(spark, sf, "part").select("p_partkey", "p_retailprice")
    return validation.octiles(part.where("p_partkey % 5 <> 0"), part.where("p_partkey % 5 = 0"), "p_retailprice").select("p_partkey", "octile")


@query(
    """WITH tr AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey <> 3), m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM tr GROUP BY 1)
    SELECT c_custkey, coalesce(m, (SELECT avg(c_acctbal) FROM tr)) AS predicted FROM customer LEFT JOIN m USING (c_nationkey) WHERE c_custkey % 5 = 0""",
    "predicted",
)
def group_mean_holdout(spark, sf):
    """The mean of a nation in training, or of all for one that training lacks."""
    c = S.load(spark, sf, "customer")
    return validation.group_mean_prediction(c.where("c_custkey % 5 <> 0 AND c_nationkey <> 3"), c.where("c_custkey % 5 = 0"), "c_nationkey", "c_acctbal").select("c_custkey", "predicted")


@query(
    """WITH f AS (SELECT c_custkey % 5 AS f, c_nationkey AS g, c_acctbal AS y FROM customer), k AS (SELECT DISTINCT f FROM f), b AS (SELECT k.f, avg(y) AS base FROM k JOIN f ON f.f <> k.f GROUP BY 1),
    m AS (SELECT k.f, g, avg(y) AS m FROM k JOIN f ON f.f <> k.f GROUP BY ALL) SELECT 1 - sum((y - coalesce(m, base)) ** 2) / sum((y - base) ** 2) AS r2, count(*) AS n FROM f JOIN b USING (f) LEFT JOIN m USING (f, g)""",
    "r2",
)
def transfer_r2(spark, sf):
    """Out-of-sample R² of group means over folds."""
    c = S.load(spark, sf, "customer").withColumn("f", F.col("c_custkey") % 5)
    return validation.cross_validated(c, "f", "c_nationkey", "c_acctbal")


@query(
    f"""WITH t AS (SELECT source AS a, lang AS b, count(*) AS n FROM {OUTCOME} GROUP BY ALL), j AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j FROM t)
    SELECT a AS source, b AS match, j AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(j, 12) DESC, b) = 1""",
    "jaccard",
)
def type_jaccard(spark, sf):
    """The best overlap of each label."""
    return validation.best_jaccard(outcome(spark, sf), "source", "lang")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def crosstab(spark, sf):
    """A contingency table, long."""
    return validation.contingency(S.load(spark, sf, "labels"), "quality", "toxic")


A = "(SELECT l_orderkey AS k, sum(l_quantity) AS v, max(l_tax) AS w FROM lineitem GROUP BY 1)"


@query(
    f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only in b' WHEN b.k IS NULL THEN 'only in a' ELSE 'differs' END AS state FROM (SELECT * FROM {A} WHERE k % 97 <> 0) a
    FULL JOIN (SELECT k, v + CASE WHEN k % 11 = 0 THEN 1 ELSE 1e-12 END AS v, w FROM {A} WHERE k % 89 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR b.k % 11 = 0"""
)
def run_diff(spark, sf):
    """Rows of two runs that differ beyond a tolerance."""
    one = S.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"), F.max("l_tax").alias("w"))
    two = one.withColumn("v", F.col("v") + F.when(F.col("k") % 11 == 0, 1.0).otherwise(1e-12))
    return storage.table_diff(one.where("k % 97 <> 0"), two.where("k % 89 <> 0"), ["k"], ["v", "w"])
