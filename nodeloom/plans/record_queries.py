"""Queries on statistical records, versions, dynamics, concepts and analogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import composition as C
from ..operators import analogs as an
from ..operators import concepts, dynamics, indices, panel, records
from ..sources import standins as S
from ..sources import storage
from . import panel_queries as pq
from .registry import query

EAV = """(SELECT user_id AS node, event_type AS code, CAST(extract('day' FROM ts) % 4 AS BIGINT) AS year, event_id, value AS weight,
  TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS value FROM events)"""


def eav(spark, sf):
    rows = S.load(spark, sf, "events").select(
        F.col("user_id").alias("node"), F.col("event_type").alias("code"), (F.dayofmonth("ts") % 4).cast("long").alias("year"), "event_id", F.col("value").alias("weight"), F.get_json_object("props", "$.k").alias("text")
    )
    return records.coerced(rows, "text").drop("text")


@query(f"SELECT event_id, code, value FROM {EAV} WHERE value IS NOT NULL", "value")
def eav_coerce(spark, sf):
    """Numbers from text, rows that are none left out."""
    return eav(spark, sf).select("event_id", "code", "value")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'withheld' ELSE 'fine' END AS comment FROM events) WHERE comment IS DISTINCT FROM 'withheld'")
def null_safe_negation(spark, sf):
    """B2: a row without a comment is kept."""
    comment = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, "withheld").otherwise("fine")
    return records.without(S.load(spark, sf, "events").withColumn("comment", comment), "comment", "withheld").select("event_id")


@query("SELECT doc_id, regexp_matches(text, '(?i)the') AS has_word, contains(source, 'src1') AS in_source FROM documents WHERE lang IN ('en', 'fr')")
def text_predicates(spark, sf):
    """Membership, substring and regular expression."""
    docs = S.load(spark, sf, "documents").where(F.col("lang").isin("en", "fr"))
    return docs.select("doc_id", F.col("text").rlike("(?i)the").alias("has_word"), F.col("source").contains("src1").alias("in_source"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN greatest(least(c_acctbal, hi), lo) END AS clipped FROM customer, (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer WHERE c_custkey % 10 <> 0)", "clipped")
def clip_quantiles(spark, sf):
    """Values within their own 1% and 99% quantiles, null staying null."""
    c = S.load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("v"))
    bounds = c.agg(F.percentile("v", 0.01).alias("lo"), F.percentile("v", 0.99).alias("hi"))
    return c.crossJoin(F.broadcast(bounds)).select("c_custkey", C.clip(F.col("v"), F.col("lo"), F.col("hi")).alias("clipped"))


@query("SELECT s_suppkey, left(regexp_replace(s_name || '-77', '[^0-9]', '', 'g'), 8) AS code, CASE WHEN s_suppkey % 3 = 0 THEN translate(['А', 'В', 'С', 'D', 'Р', 'О', 'К'][s_suppkey % 7 + 1], 'АВЕКМНОРСТХ', 'ABEKMHOPCTX') END AS section FROM supplier")
def codes_and_sections(spark, sf):
    """Digits of a code, and the Latin letter of a section's title."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "АВСDРОК"]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    title = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Раздел "), letter, F.lit(" Something"))).otherwise(F.concat(F.lit("Group "), letter))
    return S.load(spark, sf, "supplier").select("s_suppkey", C.digits(F.concat("s_name", F.lit("-77"))).alias("code"), C.section_letter(title).alias("section"))


VERSIONS = "(SELECT o_custkey AS code, o_orderdate AS d0, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d1, o_orderkey FROM orders)"
VERSION = f"(SELECT code, CAST(year(d0) AS BIGINT) AS y0, CAST(coalesce(year(d1), 9999) AS BIGINT) AS y1, o_orderkey AS node FROM {VERSIONS})"


def versions(spark, sf):
    orders = S.load(spark, sf, "orders").withColumnRenamed("o_custkey", "code")
    over = Window.partitionBy("code").orderBy("o_orderdate", "o_orderkey")
    return orders.withColumn("d1", F.lead("o_orderdate").over(over)).select(
        "code", F.year("o_orderdate").cast("long").alias("y0"), F.coalesce(F.year("d1"), F.lit(9999)).cast("long").alias("y1"), F.col("o_orderkey").alias("node")
    )


@query(
    f"""WITH v AS {VERSION}, k AS (SELECT event_id, user_id * 3 AS code, user_id AS stable, CAST(1994 + event_id % 9 AS BIGINT) AS year FROM events),
    a AS (SELECT k.code, k.year, min(node) AS n FROM (SELECT DISTINCT code, year FROM k) k JOIN v ON v.code = k.code AND y0 <= year AND year < y1 GROUP BY ALL), b AS (SELECT code, min(node) AS n FROM v GROUP BY 1)
    SELECT event_id, coalesce(a.n, b.n, c.n) AS node, CASE WHEN a.n IS NOT NULL THEN 'version' WHEN b.n IS NOT NULL THEN 'code' WHEN c.n IS NOT NULL THEN 'stable' END AS rule
    FROM k LEFT JOIN a ON a.code = k.code AND a.year = k.year LEFT JOIN b ON b.code = k.code LEFT JOIN b c ON c.code = k.stable"""
)
def versioned_join(spark, sf):
    """The version valid in a year, then any version, then the stable code, with the rule that found it."""
    keys = S.load(spark, sf, "events").select("event_id", (F.col("user_id") * 3).alias("code"), F.col("user_id").alias("stable"), (F.col("event_id") % 9 + 1994).alias("year"))
    return records.versioned(keys, versions(spark, sf), "code", "year", "y0", "y1", "node", "stable").select("event_id", "node", "rule")


@query(f"SELECT code, y0, node FROM {VERSION} QUALIFY row_number() OVER (PARTITION BY code ORDER BY y0 DESC, node DESC) = 1")
def latest_version(spark, sf):
    """The last version of each code."""
    return records.latest(versions(spark, sf), "code", [F.col("y0").desc(), F.col("node").desc()]).select("code", "y0", "node")


@query(f"SELECT code, count(DISTINCT node) AS n_nodes FROM {VERSION} GROUP BY code HAVING count(DISTINCT node) > 1")
def ambiguous_codes(spark, sf):
    """Codes with more than one node."""
    return versions(spark, sf).groupBy("code").agg(F.countDistinct("node").alias("n_nodes")).where("n_nodes > 1")


YEARLY = f"(SELECT node, year, sum(value) AS value FROM (SELECT node, year, event_id % 50 AS part, min(value) AS value FROM {EAV} WHERE code = '{{c}}' AND value IS NOT NULL GROUP BY ALL) GROUP BY ALL)"


def yearly(spark, sf, code):
    return records.per_year(eav(spark, sf).withColumn("part", F.col("event_id") % 50), F.col("code") == code, ["node", "year", "part"], ["node", "year"])


@query(f"SELECT node, avg(value) AS value FROM {YEARLY.format(c='view')} GROUP BY node", "value")
def two_level_mean(spark, sf):
    """Repeats out, sums by year, then the mean of years."""
    return records.mean_of_years(yearly(spark, sf, "view"), "node")


@query(f"SELECT node, avg(w) AS value FROM (SELECT node, year, sum(weight_ * value) / sum(weight_) AS w FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 1 ELSE weight END AS weight_ FROM {EAV} WHERE code = 'click' AND value IS NOT NULL) GROUP BY ALL) GROUP BY node", "value")
def weighted_mean(spark, sf):
    """D3: weighted within a year, then averaged; a missing weight counts as 1."""
    return records.weighted_mean(eav(spark, sf).where("code = 'click'"), "node", "year", "value", "weight", F.col("event_id") % 5 == 0)


@query(
    f"SELECT coalesce(a.node, b.node) AS node, mean_ratio, pooled_ratio FROM (SELECT node, avg(n.value / d.value) AS mean_ratio FROM {YEARLY.format(c='view')} n JOIN {YEARLY.format(c='click')} d USING (node, year) WHERE d.value <> 0 GROUP BY node) a FULL JOIN (SELECT node, coalesce(sum(n.value), 0) / nullif(sum(d.value), 0) AS pooled_ratio FROM {YEARLY.format(c='click')} d LEFT JOIN {YEARLY.format(c='view')} n USING (node, year) GROUP BY node) b USING (node)",
    "mean_ratio pooled_ratio",
)
def ratio_within_year(spark, sf):
    """The mean of yearly ratios beside the ratio of sums."""
    n, d = yearly(spark, sf, "view"), yearly(spark, sf, "click")
    a = records.mean_ratio(n, d, "node", "year").where("ratio IS NOT NULL").withColumnRenamed("ratio", "mean_ratio")
    return a.join(records.pooled_ratio(n, d, "node", "year").withColumnRenamed("ratio", "pooled_ratio"), "node", "full")


YT = S.totals_sql("year")


@query(f"SELECT node, period, value, lag(value) OVER w AS before, lead(value) OVER w AS after, coalesce((value / lag(value) OVER w - 1 > 0.15 AND value / lead(value) OVER w - 1 > 0.15) OR (value / lag(value) OVER w - 1 < -0.15 AND value / lead(value) OVER w - 1 < -0.15), false) AS outlier FROM {YT} WINDOW w AS (PARTITION BY node ORDER BY period)", "value before after")
def neighbour_outlier(spark, sf):
    """Values far from both neighbours in one direction."""
    return records.single_outliers(S.totals(spark, sf, "year"), "node", "period", "value", 0.15)


@query(f"WITH a AS (SELECT node, period, value FROM {YT} WHERE (node + period) % 6 <> 0), b AS (SELECT node, period - 1 AS period, value FROM a) SELECT node, period, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN (a.value + b.value) / 2 ELSE coalesce(a.value, b.value) END AS value, a.value IS NULL OR b.value IS NULL AS approximate FROM a FULL JOIN b USING (node, period)", "value")
def annual_mean(spark, sf):
    """Means of two dates, or the one there is."""
    return records.annual_mean(S.totals(spark, sf, "year").where("(node + period) % 6 <> 0"), "node", "period", "value")


@query(
    "WITH c AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 AND NOT (c_nationkey = 2 AND c_mktsegment = 'BUILDING') THEN c_acctbal END AS v FROM customer) SELECT c_custkey, coalesce(v, median(v) OVER (PARTITION BY c_nationkey, c_mktsegment), median(v) OVER (PARTITION BY c_mktsegment)) AS v, v IS NULL AS imputed FROM c", "v"
)
def impute_group_median(spark, sf):
    """Medians of region and kind, else of the kind."""
    c = S.load(spark, sf, "customer").withColumn("v", F.when((F.col("c_custkey") % 4 != 0) & ~((F.col("c_nationkey") == 2) & (F.col("c_mktsegment") == "BUILDING")), F.col("c_acctbal")))
    return records.imputed(c, "v", "c_nationkey", "c_mktsegment").select("c_custkey", "v", "imputed")


GROUPS = "CASE p_type WHEN 'ECONOMY' THEN 'goods' WHEN 'LARGE' THEN 'goods' WHEN 'MEDIUM' THEN 'trade' WHEN 'PROMO' THEN 'trade' ELSE 'services' END"
SECTOR = f"(SELECT l_suppkey AS node, CAST(year(l_shipdate) AS BIGINT) AS year, p_type AS section, {GROUPS} AS grp, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'STANDARD' GROUP BY ALL)"
TOTAL = "(SELECT l_suppkey AS node, CAST(year(l_shipdate) AS BIGINT) AS year, sum(l_quantity) * CASE WHEN (l_suppkey + year(l_shipdate)) % 5 = 0 THEN 0.7 ELSE 1 END AS value FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"
BALANCED = f"""(WITH s AS {SECTOR}, t AS {TOTAL}, k AS (SELECT node, year, sum(value) AS k, count(DISTINCT section) AS n FROM s GROUP BY ALL),
  ok AS (SELECT t.* FROM t LEFT JOIN k USING (node, year) WHERE coalesce(k.k - t.value <= 0.5 * k.n, true)), den AS (SELECT node, sum(value) AS d FROM ok GROUP BY 1)
  SELECT den.node, g.grp AS "group", coalesce(sum(s.value) / any_value(d), 0) AS share FROM den CROSS JOIN (SELECT DISTINCT grp FROM s) g LEFT JOIN (SELECT s.* FROM s SEMI JOIN ok USING (node, year)) s ON s.node = den.node AND s.grp = g.grp GROUP BY ALL)"""


def sectors(spark, sf):
    items = S.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("node"), F.year("l_shipdate").cast("long").alias("year"), "l_quantity")
    part = S.load(spark, sf, "part").where("p_type <> 'STANDARD'").select("p_partkey", F.col("p_type").alias("section"))
    group = F.when(F.col("section").isin("ECONOMY", "LARGE"), "goods").when(F.col("section").isin("MEDIUM", "PROMO"), "trade").otherwise("services")
    rows = items.join(part, "p_partkey").groupBy("node", "year", "section").agg(F.sum("l_quantity").alias("value")).withColumn("group", group)
    total = items.groupBy("node", "year").agg(F.sum("l_quantity").alias("value")).withColumn("value", F.col("value") * F.when((F.col("node") + F.col("year")) % 5 == 0, 0.7).otherwise(1.0))
    return records.balanced_sectors(rows, total, "node", "year", "group")


@query(f"SELECT * FROM {BALANCED}", "share")
def balanced_sectors(spark, sf):
    """Sector shares over the years whose balance holds."""
    return sectors(spark, sf)


@query(f'SELECT node, greatest(1 - sum(share), 0) AS unallocated FROM {BALANCED} GROUP BY node', "unallocated")
def unallocated_share(spark, sf):
    return records.unallocated(sectors(spark, sf), "node")


AGE = "(SELECT c_nationkey AS node, CAST(c_custkey % 3 AS BIGINT) AS year, c_mktsegment AS grp, CAST(count(*) AS DOUBLE) AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') AND c_custkey % 7 <> 0 GROUP BY ALL)"
POP = "(SELECT c_nationkey AS node, CAST(c_custkey % 3 AS BIGINT) AS year, CAST(count(*) AS DOUBLE) AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') AND c_nationkey <> 4 GROUP BY ALL)"


@query(
    f"""WITH w AS (SELECT node, year, sum(value) FILTER (grp = 'BUILDING') AS b, sum(value) FILTER (grp = 'FURNITURE') AS f, sum(value) FILTER (grp = 'MACHINERY') AS m FROM {AGE} GROUP BY ALL)
    SELECT CAST(w.node AS BIGINT) AS node, avg(b / (b + f + m)) AS share_building, avg(f / (b + f + m)) AS share_furniture, avg(m / (b + f + m)) AS share_machinery FROM w LEFT JOIN {POP} p USING (node, year)
    WHERE b + f + m IS NOT NULL AND coalesce(abs((b + f + m) / p.value - 1) <= 0.15, true) GROUP BY w.node""",
    "share_building share_furniture share_machinery",
)
def age_shares(spark, sf):
    """P5: shares of exclusive groups, of years that agree with the population."""
    c = S.load(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')").select(F.col("c_nationkey").cast("long").alias("node"), (F.col("c_custkey") % 3).alias("year"), F.lower("c_mktsegment").alias("grp"), "c_custkey")
    groups = c.where("c_custkey % 7 <> 0").groupBy("node", "year", "grp").agg(F.count(F.lit(1)).cast("double").alias("value"))
    population = c.where("node <> 4").groupBy("node", "year").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return records.age_shares(groups, population, "node", "year", ["building", "furniture", "machinery"], 0.15)


COUNT = "(SELECT l_suppkey AS node, CAST(l_linenumber % 3 AS BIGINT) AS year, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE {w} GROUP BY ALL)"
TOWN, COUNTRY = "l_returnflag = 'R' AND l_suppkey % 4 <> 0", "(l_returnflag <> 'R' OR l_suppkey % 8 = 0)"


@query(
    f"""WITH j AS (SELECT t.node, t.value AS t, u.value AS u, r.value AS r FROM {COUNT.format(w='true')} t LEFT JOIN {COUNT.format(w=TOWN)} u USING (node, year) LEFT JOIN {COUNT.format(w=COUNTRY)} r USING (node, year)),
    z AS (SELECT *, u IS NULL AND coalesce(abs(r - t) <= 0.5, false) AS zero FROM j)
    SELECT node, CASE WHEN avg(CASE WHEN u IS NOT NULL THEN u WHEN zero THEN 0 END / t) > 1 THEN 1 ELSE avg(CASE WHEN u IS NOT NULL THEN u WHEN zero THEN 0 END / t) END AS share_urban, CASE WHEN bool_or(u IS NOT NULL) THEN 'observed' WHEN bool_or(zero) THEN 'structural zero' ELSE 'no data' END AS urban_status FROM z GROUP BY node""",
    "share_urban",
)
def urban_share(spark, sf):
    """P5: a missing part is zero only where the other part is the whole."""
    items = S.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), (F.col("l_linenumber") % 3).cast("long").alias("year"), "l_returnflag", "l_suppkey")
    count = lambda w: items.where(w).groupBy("node", "year").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return records.urban_share(count(TOWN), count(COUNTRY), count("true"), "node", "year")


SHOPS = "(SELECT l_suppkey AS node, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(quarter(l_shipdate) AS BIGINT) AS quarter, p_type AS kind, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (p_type = 'STANDARD' AND l_suppkey % 9 = 0) GROUP BY ALL)"


@query(
    f"""WITH q AS (SELECT node, year, quarter, sum(value) FILTER (kind = 'STANDARD') AS s, sum(value) FILTER (kind NOT IN ('STANDARD', 'PROMO', 'SMALL')) AS o, sum(value) FILTER (kind = 'PROMO') AS m FROM {SHOPS} GROUP BY ALL HAVING s IS NOT NULL),
    y AS (SELECT node, year, avg(s + coalesce(o, 0)) AS value FROM q GROUP BY ALL), d AS (SELECT node, avg(y.value / p.value) * 1000 AS retail_per_1000 FROM y JOIN {YT.replace('AS period', 'AS year').replace('BETWEEN 1996', 'BETWEEN 1996')} p USING (node, year) GROUP BY node)
    SELECT node, avg(coalesce(m, 0) / s) AS modern_share, retail_per_1000 FROM q LEFT JOIN d USING (node) GROUP BY node, retail_per_1000""",
    "modern_share retail_per_1000",
)
def retail_objects(spark, sf):
    """P5: objects per head and the share of modern formats; a quarter without its total is missing."""
    items = S.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("node"), F.year("l_shipdate").cast("long").alias("year"), F.quarter("l_shipdate").alias("quarter"), "l_quantity")
    objects = items.join(S.load(spark, sf, "part").select("p_partkey", F.col("p_type").alias("kind")), "p_partkey").where("NOT (kind = 'STANDARD' AND node % 9 = 0)").groupBy("node", "year", "quarter", "kind").agg(F.sum("l_quantity").alias("value"))
    population = S.totals(spark, sf, "year").withColumnRenamed("period", "year")
    return records.retail(objects, population, "node", "year", "quarter", "STANDARD", ["PROMO"], ["PROMO", "SMALL"])


@query(
    f"""WITH spec AS (SELECT * FROM (VALUES ('view', [0, 1, 2]), ('click', [0, 1, 2, 3]), ('error', [3]), ('absent', [0])) s(code, years)), h AS (SELECT DISTINCT e.code, e.year, e.node FROM {EAV} e WHERE node % 2 = 0 AND value IS NOT NULL),
    n AS (SELECT h.code, node, count(*) AS c, any_value(len(years)) AS l FROM h JOIN spec USING (code) WHERE list_contains(years, CAST(h.year AS INT)) GROUP BY ALL)
    SELECT spec.code, CAST(len(years) AS BIGINT) AS years, count(*) FILTER (c = l) AS n_all_years, count(node) AS n_any_year FROM spec LEFT JOIN n USING (code) GROUP BY ALL"""
)
def data_passport(spark, sf):
    """How many nodes an indicator covers in all of its years, and in any."""
    spec = spark.createDataFrame([("view", [0, 1, 2]), ("click", [0, 1, 2, 3]), ("error", [3]), ("absent", [0])], "code string, years array<bigint>")
    ids = S.load(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("node")).distinct()
    return records.passport(eav(spark, sf), spec, ids, "node", "code", "year")


@query(
    """WITH n AS (SELECT s_suppkey AS node, s_nationkey AS region FROM supplier), c AS (SELECT region, node AS cap FROM n WHERE node % 6 = 0) SELECT n.node, min(CASE WHEN n.node = cap THEN 0 WHEN (n.node + cap) % 5 <> 0 THEN abs(n.node - cap) * 2.0 END) AS distance FROM n LEFT JOIN c USING (region) GROUP BY n.node""",
    "distance",
)
def capital_distance(spark, sf):
    """The nearest capital of a node's own region, where a way exists."""
    nodes = S.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("region"))
    other = nodes.select(F.col("node").alias("dst"), "region")
    ways = nodes.withColumnRenamed("node", "src").join(other, "region").where("(src + dst) % 5 <> 0").select("src", "dst", (F.abs(F.col("src") - F.col("dst")) * 2.0).alias("weight"))
    return records.to_capital(nodes, nodes.where("node % 6 = 0"), ways, "node", "region")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def joined_codes(spark, sf):
    """Sorted distinct codes in one string."""
    return S.load(spark, sf, "orders").groupBy("o_custkey").agg(F.concat_ws(";", F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"))


@query("SELECT * FROM (SELECT l_suppkey AS node, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def pivot_counts(spark, sf):
    """A pivot with the values given, so that it needs no extra scan."""
    counts = S.load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("node")).pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return counts.select("node", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS n_both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_without, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 10 UNION SELECT o_custkey FROM orders)) AS n_any")
def id_sets(spark, sf):
    """Sizes of the overlap, difference and union of id sets."""
    c, o = S.load(spark, sf, "customer"), S.load(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    few = c.where("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    count = lambda df, a: df.agg(F.count(F.lit(1)).alias(a))
    both, rest, any_ = o.intersect(few), c.select(F.col("c_custkey").alias("id")).subtract(o), few.union(o).distinct()
    return count(both, "n_both").crossJoin(count(rest, "n_without")).crossJoin(count(any_, "n_any"))


@query("SELECT n_nationkey AS nation, coalesce(lat, c_lat) AS lat FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 2.5 END AS lat, n_nationkey * 2.0 AS c_lat FROM nation)", "lat")
def centroid_fallback(spark, sf):
    """A missing place is that of the polygon's centroid, which comes precomputed."""
    n = S.load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))
    return n.select("nation", F.coalesce(F.when(F.col("nation") % 3 != 0, F.col("nation") * 2.5), F.col("nation") * 2.0).alias("lat"))


@query("SELECT event_type, CAST(extract('day' FROM ts) AS BIGINT) AS day, count(*) AS n FROM events WHERE extract('day' FROM ts) < 16 GROUP BY ALL UNION ALL SELECT event_type, CAST(NULL AS BIGINT), count(*) FROM events WHERE extract('day' FROM ts) >= 16 GROUP BY ALL")
def part_concat(spark, sf):
    """Parts whose columns differ, concatenated; together they cover all days."""
    e = S.load(spark, sf, "events").withColumn("day", F.dayofmonth("ts").cast("long"))
    one = e.where("day < 16").groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    return storage.concatenated([one, e.where("day >= 16").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))])


# -- dynamics

QLABELS = "(SELECT user_id AS node, CAST(floor((epoch(ts) - 1704067200) / 345600) AS BIGINT) AS period, min(event_type) AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor((epoch(ts) - 1704067200) / 345600) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1, 2)"


def qlabels(spark, sf):
    e = S.load(spark, sf, "events").withColumn("period", F.expr("datediff(ts, date'2024-01-01') div 4"))
    over = Window.partitionBy("user_id", "period").orderBy(F.col("value").desc(), "event_id")
    return e.withColumn("_r", F.row_number().over(over)).where("_r = 1").select(F.col("user_id").alias("node"), "period", F.col("event_type").alias("label"))


@query(f"SELECT label, following, count(*) AS n FROM (SELECT label, lead(label) OVER (PARTITION BY node ORDER BY period) AS following FROM {QLABELS}) WHERE following IS NOT NULL GROUP BY ALL")
def transition_matrix(spark, sf):
    return dynamics.transitions(qlabels(spark, sf))


@query(
    f"""WITH q AS (SELECT *, row_number() OVER w - 1 AS p, coalesce(label <> lag(label) OVER w, false) AS c FROM (SELECT node, period, CASE WHEN label < 'f' THEN 'a' ELSE 'b' END AS label FROM {QLABELS}) WINDOW w AS (PARTITION BY node ORDER BY period)),
    f AS (SELECT node, count(*) FILTER (c) AS changes, min(p) FILTER (c) AS turn, count(*) AS n FROM q GROUP BY node)
    SELECT node, changes, CASE WHEN changes = 0 THEN 'stable' WHEN changes = 1 AND n - turn >= 2 THEN 'persistent shift' ELSE 'fluctuation' END AS trajectory FROM f"""
)
def trajectory_class(spark, sf):
    coarse = qlabels(spark, sf).withColumn("label", F.when(F.col("label") < "f", "a").otherwise("b"))
    return dynamics.trajectories(coarse)


@query(f"SELECT node, CAST(y AS BIGINT) AS year, label AS mode FROM (SELECT node, period // 4 AS y, label, count(*) AS n, max(period) AS last FROM {QLABELS} GROUP BY node, period // 4, label) QUALIFY row_number() OVER (PARTITION BY node, y ORDER BY n DESC, last DESC) = 1")
def yearly_mode(spark, sf):
    return dynamics.mode_last(qlabels(spark, sf).withColumn("year", F.expr("period div 4")), ["node", "year"])


@query(f"SELECT period, label, n / sum(n) OVER (PARTITION BY period) AS share FROM (SELECT period, label, count(*) AS n FROM {QLABELS} GROUP BY ALL)", "share")
def label_shares(spark, sf):
    """Shares of labels in each period."""
    return dynamics.label_shares(qlabels(spark, sf))


CENTRE = "(SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM (SELECT CAST(label AS BIGINT) AS label, unnest(range(1, 65)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings {w}) GROUP BY ALL) GROUP BY label)"


@query(
    f"SELECT vec_id AS node, e.label, arg_min(c.label, (d, c.label)) AS assigned FROM (SELECT vec_id, CAST(e.label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings e WHERE vec_id % 4 = 0) e, {CENTRE.format(w='WHERE vec_id % 4 <> 0')} c, LATERAL (SELECT round(list_distance(x, c.c) ** 2, 12) AS d) GROUP BY ALL"
)
def nearest_centroid(spark, sf):
    """Held-out vectors to the nearest training centre."""
    v = S.vectors(spark, sf)
    return dynamics.nearest_centre(v.where("node % 4 = 0"), indices.centres(v.where("node % 4 <> 0")).select("label", "centre"))


def _period_vectors(spark, sf):
    cells = S.cells(spark, sf, "month")
    z = panel.period_features(cells, S.NAMED, S.RESIDUAL, 3)
    return z.select("node", "period", (F.col("node") % 4).alias("label"), F.array(*[F.col(c) for c in z.columns if c not in ("node", "period")]).alias("x"))


_PV = f"(SELECT node, period, node % 4 AS label, [{', '.join([f'clr_{c}' for c in pq.LOWER] + ['level'])}] AS x FROM {pq._period_sql()})"


@query(
    f"""WITH v AS {_PV}, c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(e) AS m FROM (SELECT label, unnest(range(1, 8)) AS pos, unnest(x) AS e FROM v) GROUP BY ALL) GROUP BY label)
    SELECT node, period, v.label, arg_min(c.label, (round(1 - list_cosine_similarity(x, c.c), 9), c.label)) AS assigned FROM v, c GROUP BY ALL"""
)
def assign_periods(spark, sf):
    """Each node-quarter to the nearest prototype by cosine."""
    return dynamics.assign_periods(_period_vectors(spark, sf))


W_LABELS = "(SELECT node, w_end AS period, label FROM (SELECT node, w_end, CAST(floor(rank() OVER (PARTITION BY w_end ORDER BY {c}, node) * 3 / 101) AS BIGINT) AS label FROM {f}))"


@query(
    f"""WITH r AS (SELECT node, w_end AS period, avg(r) AS level, stddev_pop(r) AS sd FROM {pq._res_sql(S.totals_sql("month"))} JOIN {pq.WINDOWS} ON period BETWEEN w_start AND w_end GROUP BY ALL),
    a AS (SELECT node, period, CAST(level > 0 AS BIGINT) AS la, CAST(level > 0.05 AS BIGINT) AS lb FROM r),
    p AS (SELECT node, max(la) FILTER (period = {pq.FIRST_END}) AS a0, max(la) FILTER (period = {pq.LAST_END} - 3) AS a1, max(la) FILTER (period = {pq.LAST_END}) AS a2, max(lb) FILTER (period = {pq.FIRST_END}) AS b0, max(lb) FILTER (period = {pq.LAST_END}) AS b2 FROM a GROUP BY node)
    SELECT node, a0 AS origin, a2 AS target FROM p WHERE a0 <> a2 AND a1 = a2 AND b0 <> b2"""
)
def persistent_moves(spark, sf):
    """Nodes that moved, had settled, and moved in a second partition too."""
    res, first, last = pq.windowed_residuals(spark, sf)
    level = res.groupBy("node", F.col("w_end").alias("period")).agg(F.avg("r").alias("level"))
    label = lambda t: level.select("node", "period", (F.col("level") > t).cast("long").alias("label"))
    return dynamics.persistent_moves(label(0.0), label(0.05), first, last)


# -- pattern codes, concepts, analogs

SHARES = f"(SELECT node, {', '.join(f'round(avg({c}), 2) AS {c}' for c in pq.LOWER[:5])} FROM {pq._shares_sql(pq.YEAR)} GROUP BY node)"


def _code_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 WHEN {a} < {b} THEN 1 ELSE 2 END"


CODES = f"(SELECT node, [{', '.join(_code_sql(pq.LOWER[i], pq.LOWER[j]) for i in range(4) for j in range(i + 1, 4))}] AS codes FROM {SHARES})"


def codes(spark, sf):
    long = panel.shares(S.cells(spark, sf), S.NAMED, S.RESIDUAL)
    wide = panel.share_vectors(long, pq.CATS[:4], ["node"]).withColumn("s", F.transform("shares", lambda v: F.round(v, 2)))
    return wide.select("node", C.pair_codes(F.col("s"), 4).alias("codes"))


@query(f"SELECT node, array_to_string(codes, '') AS code FROM {CODES}")
def pattern_codes(spark, sf):
    """The order of all pairs of shares."""
    return codes(spark, sf).select("node", F.concat_ws("", F.transform("codes", lambda c: c.cast("string"))).alias("code"))


@query(f"SELECT array_to_string(codes, '') AS code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, array_to_string(codes, '')) - 1 AS label FROM {CODES} GROUP BY codes")
def pattern_clusters(spark, sf):
    """Nodes with one order form a cluster; labels by size."""
    from ..operators import clustering

    return clustering.pattern_clusters(codes(spark, sf)).select(F.concat_ws("", F.transform("codes", lambda c: c.cast("string"))).alias("code"), "n", "label")


@query(
    f"""WITH c AS {CODES}, k AS (SELECT codes, row_number() OVER (ORDER BY count(*) DESC, codes) - 1 AS label FROM c GROUP BY codes QUALIFY label < 4)
    SELECT node, arg_min(label, (d, label)) AS label, min(d) AS distance FROM c, LATERAL (SELECT label, list_sum(list_transform(list_zip(c.codes, k.codes), lambda z: CASE WHEN z[1] = z[2] THEN 0 WHEN z[1] = 0 OR z[2] = 0 THEN 0.5 ELSE 1 END)) AS d FROM k) GROUP BY node""",
    "distance",
)
def pattern_k(spark, sf):
    """The most frequent orders as centres, the rest by Kemeny distance."""
    from ..operators import clustering

    return clustering.pattern_k(codes(spark, sf), 4)


FCA = ["level", "growth", "summer", "volatility"]
_SOURCE = f"(SELECT node, {', '.join(f'round({c}, 6) AS {c}' for c in FCA)} FROM {pq._static_sql()})"


def _mask_sql() -> str:
    cuts = ", ".join(f"list_transform(quantile_cont({c}, [{1 - 1 / 3}, {1 / 3}, 0.9, 0.1]), lambda x: round(x, 9)) AS q_{c}" for c in FCA)
    bits = " + ".join(f"CASE WHEN {c} {'>=' if i % 2 == 0 else '<='} q_{c}[{i + 1}] THEN {1 << (4 * k + i)} ELSE 0 END" for k, c in enumerate(FCA) for i in range(4))
    return f"(SELECT node, CAST({bits} AS BIGINT) AS mask FROM {_SOURCE}, (SELECT {cuts} FROM {_SOURCE}))"


COMBOS = "(SELECT DISTINCT CAST((1 << a) | (1 << b) | (1 << c) AS BIGINT) AS combo, bit_count(CAST((1 << a) | (1 << b) | (1 << c) AS BIGINT)) AS length FROM range(16) x(a), range(16) y(b), range(16) z(c))"
EXTENTS = f"(SELECT combo, length, bit_and(mask) AS intent, count(*) AS extent FROM {_mask_sql()} JOIN {COMBOS} ON mask & combo = combo GROUP BY ALL HAVING count(*) >= 10)"
CONCEPTS = f"(SELECT intent, max(extent) AS extent FROM {EXTENTS} GROUP BY intent)"


def masks(spark, sf):
    wide = pq.features(spark, sf)
    return concepts.scaled(wide.select("node", *[F.round(c, 6).alias(c) for c in FCA]), FCA)


@query(f"SELECT * FROM {_mask_sql()}")
def fca_scale(spark, sf):
    """O1: ordinal attributes as bits."""
    return masks(spark, sf)


@query(f"SELECT * FROM {CONCEPTS}")
def fca_concepts(spark, sf):
    """O2, O3: closures of up to three attributes."""
    return concepts.concepts(masks(spark, sf), concepts.combos(spark, 16))


@query(
    f"SELECT intent, extent - max(n) AS delta FROM (SELECT intent, extent, b, count(*) FILTER (mask & (1 << b) <> 0 AND intent & (1 << b) = 0) AS n FROM {CONCEPTS} JOIN {_mask_sql()} ON mask & intent = intent, range(16) t(b) GROUP BY ALL) GROUP BY intent, extent"
)
def fca_delta(spark, sf):
    """How stable a concept is against one more attribute."""
    m = masks(spark, sf)
    return concepts.delta(m, concepts.concepts(m, concepts.combos(spark, 16)), 16)


@query(
    f"SELECT intent, combo AS generator, CAST(length AS INT) AS length FROM {EXTENTS} QUALIFY row_number() OVER (PARTITION BY intent ORDER BY length, reverse(lpad(bin(combo), 64, '0')) DESC) = 1"
)
def fca_generators(spark, sf):
    """The shortest description of a concept."""
    return concepts.generators(masks(spark, sf), concepts.combos(spark, 16))


@query(
    f"""WITH m AS {_mask_sql()}, l AS (SELECT node, node % 2 AS label FROM m), k AS (SELECT label, count(*) AS k FROM l GROUP BY 1),
    h AS (SELECT label, intent, extent, count(*) AS hit FROM {CONCEPTS} JOIN m ON mask & intent = intent JOIN l USING (node) GROUP BY ALL),
    s AS (SELECT label, intent, extent, hit / extent AS precision, hit / k AS coverage FROM h JOIN k USING (label) WHERE hit / extent >= 0.6)
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY round(2 * precision * coverage / (precision + coverage), 12) DESC, bit_count(intent), intent) AS place, intent, extent, precision, coverage FROM s QUALIFY place <= 3""",
    "precision coverage",
)
def fca_describe(spark, sf):
    """The best concepts of each label."""
    m = masks(spark, sf)
    return concepts.describe(m, m.select("node", (F.col("node") % 2).alias("label")), concepts.combos(spark, 16))


EMB = "(SELECT vec_id AS node, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query(f"SELECT a.node AS src, b.node AS dst, row_number() OVER (PARTITION BY a.node ORDER BY round(list_distance(a.x, b.x) ** 2, 9), b.node) AS place FROM {EMB} a JOIN {EMB} b ON a.label = b.label AND a.node <> b.node QUALIFY place <= 7")
def analogs(spark, sf):
    """The seven nearest of the same type."""
    return an.analogs(S.vectors(spark, sf), 7, same="label")


@query(f"SELECT a.node AS src, b.node AS dst, row_number() OVER (PARTITION BY a.node ORDER BY (a.label = b.label) DESC, round(list_distance(a.x, b.x) ** 2, 9), b.node) AS place FROM {EMB} a JOIN {EMB} b ON a.node <> b.node QUALIFY place <= 60")
def analogs_region_first(spark, sf):
    """the own group first, then the others."""
    return an.analogs(S.vectors(spark, sf), 60, first="label")


@query(
    f"""WITH f AS (SELECT a.node AS src, b.node AS dst FROM {EMB} a JOIN {EMB} b ON a.label = b.label AND a.node <> b.node QUALIFY row_number() OVER (PARTITION BY a.node ORDER BY round(list_distance(a.x, b.x) ** 2, 9), b.node) <= 7),
    g AS (SELECT a.node, abs(avg(b.x[2]) - any_value(a.x[2])) AS d FROM f JOIN {EMB} a ON a.node = src JOIN {EMB} b ON b.node = dst GROUP BY a.node) SELECT median(d / s) AS median_deviation, count(*) AS n FROM g, (SELECT stddev_samp(x[2]) AS s FROM {EMB})""",
    "median_deviation",
)
def analog_deviation(spark, sf):
    """How far analogs' means are from the node's own value."""
    v = S.vectors(spark, sf)
    return an.deviation(an.analogs(v, 7, same="label"), v.select("node", F.col("x")[1].alias("v")), "v")


# -- composite pipelines

FLAG = ["level", "growth", "summer"]


@query(
    f"""WITH c AS {S.cells_sql("quarter")}, ok AS (SELECT node FROM c GROUP BY node HAVING count(DISTINCT period) >= {pq.QUARTERS} AND count(*) >= {pq.QUARTERS} * 6 - {pq.GAPS}), p AS (SELECT c.* FROM c SEMI JOIN ok USING (node)),
    z AS {pq._clr_sql(pq._shares_sql('p'), 'node')}, l AS (SELECT node, avg(r) AS level FROM (SELECT node, period, ln(v) - median(ln(v)) OVER (PARTITION BY period) AS r FROM (SELECT node, period, sum(value) AS v FROM p GROUP BY ALL)) GROUP BY node),
    s AS {pq._z_sql('(SELECT * FROM z JOIN l USING (node))', 'node', {'structure': [f'clr_{c}' for c in pq.LOWER], 'level': ['level']})}
    SELECT CAST(n_regionkey AS BIGINT) AS region, {', '.join(f'median({c}) AS {c}' for c in [*[f'clr_{c}' for c in pq.LOWER], 'level'])}, count(*) AS n_nodes, count(DISTINCT s_nationkey) AS n_nations
    FROM s JOIN supplier ON s_suppkey = node JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
    pq.CLR_COLUMNS + " level",
)
def flagship(spark, sf):
    """P7 end to end: complete series, shares, log-ratios, level, balanced blocks, medians by region."""
    n = pq.quarters(spark, sf)
    cells = panel.complete_series(S.cells(spark, sf, "quarter"), n, 6 - pq.GAPS / n)
    z = panel.share_vectors(panel.shares(cells, S.NAMED, S.RESIDUAL), pq.CATS, ["node"]).select("node", C.clr(F.col("shares")).alias("z"))
    wide = z.select("node", *[F.col("z")[i].alias(f"clr_{c}") for i, c in enumerate(pq.LOWER)])
    total = cells.groupBy("node", "period").agg(F.sum("value").alias("value"))
    joined = wide.join(panel.level(panel.residuals(total, ["period"])), "node")
    names = [*[f"clr_{c}" for c in pq.LOWER], "level"]
    std = panel.standardise_blocks(joined, {"structure": names[:6], "level": ["level"]}).join(S.node_region(spark, sf), "node")
    return std.groupBy("region").agg(*[F.median(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("nation").alias("n_nations"))


@query(
    f"""WITH f AS (SELECT s.node, s.level, s_nationkey, s_acctbal FROM {_SOURCE} s JOIN supplier ON s_suppkey = node), g AS (SELECT node, s_nationkey, ln(value / (s_acctbal + 2000)) - median(ln(value / (s_acctbal + 2000))) OVER () AS gap FROM (SELECT node, sum(value) AS value FROM {S.totals_sql('year')} GROUP BY node) JOIN f USING (node))
    SELECT CAST(s_nationkey AS BIGINT) AS nation, median(gap) AS gap, max_by(node, (gap, -node)) AS most, min_by(node, (gap, node)) AS least FROM g GROUP BY s_nationkey""",
    "gap",
)
def spending_gap(spark, sf):
    """Log spending over income less its median, with the extremes of each nation."""
    nodes = S.node_region(spark, sf).join(pq.features(spark, sf).select("node"), "node", "left_semi")
    spent = S.totals(spark, sf, "year").groupBy("node").agg(F.sum("value").alias("value"))
    g = panel.less_median(spent.join(nodes, "node"), {"gap": F.ln(F.try_divide("value", F.col("s_acctbal") + 2000))}, [])
    return g.groupBy("nation").agg(F.median("gap").alias("gap_"), F.max_by("node", F.struct("gap", -F.col("node"))).alias("most"), F.min_by("node", F.struct("gap", "node")).alias("least")).withColumnRenamed("gap_", "gap")


@query(
    "SELECT region, to_json(list({'node': node, 'value': v} ORDER BY node)) AS payload FROM (SELECT CAST(n_regionkey AS BIGINT) AS region, s_suppkey AS node, CAST(s_nationkey AS BIGINT) AS v FROM supplier JOIN nation ON n_nationkey = s_nationkey) GROUP BY region"
)
def json_payload(spark, sf):
    """Nested arrays of nodes as JSON."""
    rows = S.node_region(spark, sf).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", F.col("nation").alias("value")))).alias("p"))
    return rows.select("region", F.to_json("p").alias("payload"))
