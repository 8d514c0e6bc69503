"""Operators of the panel, graphs, indices and ranks against values worked out by hand or in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nodeloom.functions import composition as C
from nodeloom.functions import tails
from nodeloom.operators import clustering, graph, indices, panel, ranking, stats, validation


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def panel_frame(spark, cells):
    return spark.createDataFrame([(n, p, c, float(v)) for n, p, c, v in cells], "node long, period long, category string, value double")


def test_integrity_stops_at_repeats_and_values_not_above_zero(spark):
    good = panel_frame(spark, [(1, 1, "a", 2), (1, 2, "a", 3)])
    assert panel.checked(good, ["node", "period", "category"], "value").count() == 2
    with pytest.raises(ValueError, match="repeat"):
        panel.checked(good.unionByName(good), ["node", "period", "category"], "value")
    with pytest.raises(ValueError, match="positive"):
        panel.checked(panel_frame(spark, [(1, 1, "a", 0)]), ["node"], "value")


def test_complete_series_needs_every_cell(spark):
    cells = [(1, p, c, 1) for p in (1, 2) for c in "ab"] + [(2, 1, "a", 1), (2, 1, "b", 1), (2, 2, "a", 1)]
    assert {r["node"] for r in panel.complete_series(panel_frame(spark, cells), 2, 2).collect()} == {1}


def test_shares_and_residual_category(spark):
    got = panel.shares(panel_frame(spark, [(1, 1, "a", 2), (1, 1, "b", 3), (1, 1, "x", 5)]), ("a", "b"), "rest")
    assert dict(rows(got, "category", "share")) == pytest.approx({"a": 0.2, "b": 0.3, "rest": 0.5})


def test_log_ratios(spark):
    x = np.array([0.5, 0.3, 0.2])
    row = spark.range(1).select(C.clr(F.array(*map(F.lit, x.tolist()))).alias("c"), C.ilr(F.array(*map(F.lit, x.tolist())), 3).alias("i")).first()
    logs = np.log(x)
    assert row["c"] == pytest.approx((logs - logs.mean()).tolist()) and sum(row["c"]) == pytest.approx(0)
    assert row["i"] == pytest.approx([math.sqrt(2 / 3) * (logs[0] - logs[1:].mean()), math.sqrt(1 / 2) * (logs[1] - logs[2])])
    assert np.linalg.norm(row["i"]) == pytest.approx(np.linalg.norm(row["c"]))


def test_pair_codes_and_kemeny(spark):
    code = lambda v: C.pair_codes(F.array(*map(F.lit, v)), 3)
    row = spark.range(1).select(code([1.0, 2.0, 2.0]).alias("a"), code([2.0, 1.0, 3.0]).alias("b")).select("a", "b", C.kemeny(F.array(*map(F.lit, [1, 1, 0])), F.array(*map(F.lit, [2, 1, 1]))).alias("k")).first()
    assert row["a"] == [1, 1, 0] and row["b"] == [2, 1, 1] and row["k"] == 1.5


def test_section_letters_digits_and_clip(spark):
    df = spark.createDataFrame([("Раздел А Farming", "12 345-678-90", 5.0), ("Раздел С", "7", -5.0), ("Total", "", None)], "t string, d string, v double")
    got = df.select(C.section_letter(F.col("t")), C.digits(F.col("d")), C.clip(F.col("v"), 0.0, 1.0)).collect()
    assert [tuple(r) for r in got] == [("A", "12345678", 1.0), ("C", "7", 0.0), (None, "", None)]


def test_detrended_deviation(spark):
    t = np.arange(12.0)
    y = 3 + 0.5 * t + np.sin(t)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)] + [(2, i, 4.0) for i in range(5)], "node long, t long, r double")
    got = dict(rows(panel.detrended_sd(df), "node", "volatility"))
    slope, base = np.polyfit(t, y, 1)
    assert got[1] == pytest.approx((y - slope * t - base).std()) and got[2] == 0


def test_best_lag_sign_and_ties(spark):
    wave = [math.sin(i) for i in range(30)]
    series = [(1, t, wave[t + 2]) for t in range(25)] + [(2, t, wave[t]) for t in range(25)] + [(3, t, float(t % 2)) for t in range(25)]
    df = spark.createDataFrame(series, "node long, period long, v double")
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "x long, y long")
    got = {(r["x"], r["y"]): r["lag"] for r in panel.best_lag(panel.lagged_correlations(df, pairs, 3, True).withColumn("r", F.round("r", 9))).collect()}
    assert got == {(1, 2): 2, (3, 3): -2}


def test_lags_of_gappy_and_constant_series_equal_their_sql(spark, tmp_path, monkeypatch):
    import datetime

    import duckdb

    from nodeloom.operators import pairs
    from nodeloom.plans import catalogue

    rng = np.random.default_rng(13)
    items = []
    for node in range(1, 19):
        for q in range(12):
            if rng.random() < (0.9 if node < 9 else 0.35):
                price = 100.0 if node % 5 == 0 else float(np.round(100 + 50 * rng.random(), 2))
                items.append((node, datetime.datetime(2020 + q // 4, 1 + q % 4 * 3, 2), price, 0.0))
    spark.createDataFrame(items, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(1, 19)] + [(30, None)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(pairs, "THIN", 16)
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, numbers in (("lagged_correlations", 1), ("best_lag", 1), ("leadlag_shares", 0)):
        found = catalogue.QUERIES[name](spark, str(tmp_path))
        got = sorted(tuple(r) for r in found.collect())
        want = sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
        assert len(got) == len(want) > 0
        assert [repr(g) for g in got] == [repr(w) for w in want]
        assert not numbers or any(math.isnan(g[3]) for g in got)


def test_knn_is_symmetric_and_mutual_is_smaller(spark):
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(rng.standard_normal((50, 3)))], "node long, label long, x array<double>")
    one, two = graph.knn_graph(v, 5), graph.knn_graph(v, 5, mutual=True)
    edges = {(r["src"], r["dst"]): r["weight"] for r in one.collect()}
    assert all(edges[(b, a)] == w for (a, b), w in edges.items()) and all(a != b for a, b in edges)
    mutual = {(r["src"], r["dst"]) for r in two.collect()}
    assert mutual < set(edges) and all((b, a) in mutual for a, b in mutual)


def edge_frame(spark, pairs):
    return graph.symmetric(spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "a long, b long, weight double"))


def test_network_indices_by_hand(spark):
    edges = edge_frame(spark, [(0, 1, 2), (2, 3, 1), (1, 2, 1)])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, label long")
    row = indices.network_indices(edges, labels).first()
    assert row["avi"] == pytest.approx((4 / 5 + 2 / 3) / 2) and row["avu"] == pytest.approx(1) and row["mq"] == pytest.approx(6 / 8 - (25 + 9) / 64)


def test_three_clusters_by_hand(spark):
    s = [(0, 0, 6.0), (0, 1, 1.0), (0, 2, 0.5), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, 0.5), (2, 1, 2.0), (2, 2, 4.0)]
    edges = spark.createDataFrame([(a * 10, b * 10 + 1, w) for a, b, w in s], "src long, dst long, weight double")
    labels = spark.createDataFrame([(a * 10 + i, a) for a in range(3) for i in (0, 1)], "node long, label long")
    row = indices.network_indices(edges, labels).first()
    assert row["avi"] == pytest.approx(np.mean([6 / 7.5, 2 / 5, 4 / 6.5])) and row["avu"] == pytest.approx(2 / 3) and row["mq"] == pytest.approx(12 / 19 - 123.5 / 361)


def test_s_dbw_by_hand(spark):
    one = lambda values: spark.createDataFrame([(i, int(i >= 3), [float(v)]) for i, v in enumerate(values)], "node long, label long, x array<double>")
    assert indices.s_dbw(one([0, 1, 2, 3, 4, 5])).first()[0] == pytest.approx(0.228571 + 2, abs=1e-5)
    assert indices.s_dbw(one([0, 1, 2, 10, 11, 12])).first()[0] == pytest.approx((2 / 3) / (154 / 6))


def test_silhouette_by_hand(spark):
    v = spark.createDataFrame([(i, int(i > 1), [float(x)]) for i, x in enumerate([0, 1, 5, 7])] + [(9, 2, [100.0])], "node long, label long, x array<double>")
    got = dict(rows(indices.silhouette(v), "node", "sw"))
    assert got[0] == pytest.approx(1 - 1 / 6) and got[3] == pytest.approx((6.5 - 2) / 6.5) and got[9] == 0


def test_ranks_with_ties_and_nulls_and_aggregation(spark):
    values = spark.createDataFrame([("a", "up", 3.0), ("b", "up", 1.0), ("c", "up", None), ("a", "down", 1.0), ("b", "down", 1.0), ("c", "down", 5.0)], "candidate string, index string, value double")
    ranks = ranking.rank_table(values, {"up": 1, "down": -1})
    assert rows(ranks, "candidate", "index", "place") == [("a", "down", 1.5), ("a", "up", 1.0), ("b", "down", 1.5), ("b", "up", 2.0), ("c", "down", 3.0), ("c", "up", 3.0)]
    assert rows(ranking.aggregate(ranks), "candidate", "borda", "copeland", "borda_place", "copeland_place") == [("a", 3.5, 2, 1, 1), ("b", 2.5, 0, 2, 2), ("c", 0.0, -2, 3, 3)]
    w = ranking.kendall_w(ranks).first()[0]
    sums = np.array([2.5, 3.5, 6.0])
    assert w == pytest.approx(12 * ((sums - 4) ** 2).sum() / (4 * 24))
    with pytest.raises(ValueError, match="stable"):
        ranking.choose(ranking.aggregate(ranks), spark.createDataFrame([("a", 0.1)], "candidate string, stability double"), 0.6)


def test_adjusted_indices_of_partitions(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    b[:150] = a[:150] % 3
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert validation.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(stats.plain_ari(a, b))
    assert validation.adjusted_rand(df, "a", "a").first()[0] == pytest.approx(1) and validation.adjusted_mutual_information(df, "a", "a") == pytest.approx(1)
    assert 0 < validation.adjusted_mutual_information(df, "a", "b") < 1


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(4)
    for shape in [(4, 4), (3, 5), (5, 3), (1, 1), (6, 6)] * 8:
        cost = rng.integers(0, 30, shape).astype(float)
        got = validation.assign(cost)
        assert len(got) == min(shape) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        small = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))
        assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_q_values_run_back_and_clip(spark):
    p = [0.01, 0.04, 0.03, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "key long, p double")
    assert [r[1] for r in rows(validation.q_values(df, "key", "p"), "key", "q")] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])
    c = 1 + 1 / 2 + 1 / 3 + 1 / 4
    assert [r[1] for r in rows(validation.q_values(df, "key", "p", True), "key", "q")] == pytest.approx([0.04 * c, 0.16 / 3 * c, 0.16 / 3 * c, 1.0])


def test_octiles_of_training_values(spark):
    train = spark.createDataFrame([(float(i),) for i in range(1, 81)], "v double")
    test = spark.createDataFrame([(0.5,), (40.5,), (80.5,), (None,)], "v double")
    assert [r["octile"] for r in validation.octiles(train, test, "v").collect()] == [0, 4, 7, -1]
    assert {r["count"] for r in validation.octiles(train, train, "v").groupBy("octile").count().collect()} == {10}


def test_tails_against_known_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025) and tails.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)


def test_ols_equals_group_means_and_clusters(spark):
    rng = np.random.default_rng(5)
    x, g = rng.standard_normal(120), np.arange(120) % 8
    y = 2 + 3 * x + rng.standard_normal(120) + g * 0.2
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, g, strict=True)], "x double, y double, g long")
    fit = stats.ols(df, "y", ["x"], "g")
    design = np.column_stack([np.ones(120), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert fit["beta"].tolist() == pytest.approx(beta.tolist())
    e, inv = y - design @ beta, np.linalg.inv(design.T @ design)
    scores = np.stack([(design[g == k] * e[g == k, None]).sum(axis=0) for k in range(8)])
    assert fit["se"].tolist() == pytest.approx(np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * 8 / 7 * 119 / 118).tolist())
    h = (design @ inv * design).sum(axis=1)
    hc3 = inv @ (design.T * (e / (1 - h)) ** 2) @ design @ inv
    assert stats.ols(df, "y", ["x"])["se"].tolist() == pytest.approx(np.sqrt(np.diag(hc3)).tolist())
    means = stats.dummy_prediction(df, df, ["g"], "y").groupBy("g").agg(F.avg("predicted").alias("p"), F.avg("y").alias("m")).collect()
    assert all(r["p"] == pytest.approx(r["m"]) for r in means)


def ring(spark, n, reach=2):
    return edge_frame(spark, [(i, (i + k) % n, 1) for i in range(n) for k in range(1, reach + 1)])


def test_local_moran_finds_planted_clusters_only(spark):
    rng = np.random.default_rng(6)
    n = 120
    high = np.where(np.arange(n) < 20, 3.0, 0.0) + 0.3 * rng.standard_normal(n)
    frame = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "node long, v double")
    found = {r["node"]: r["cluster"] for r in stats.local_moran(ring(spark, n), frame(high), "v", 499, 2).collect()}
    assert sum(found[i] == "HH" for i in range(2, 18)) >= 14 and sum(found[i] == "HH" for i in range(30, 110)) == 0
    null = stats.local_moran(ring(spark, n), frame(rng.standard_normal(n)), "v", 499, 2)
    assert null.where("cluster <> 'ns'").count() <= 6
    i, p = stats.moran_test(ring(spark, n), frame(high), "v", 99)
    assert i > 0.5 and p == pytest.approx(0.01)


def test_rewiring_keeps_degrees_and_stays_simple():
    rng = np.random.default_rng(7)
    a, b = np.triu_indices(30, 1)
    keep = rng.random(len(a)) < 0.2
    src, dst = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
    s, d, w = stats.rewired(30, src, dst, rng.random(len(src)), 1)
    assert (np.bincount(s, minlength=30) == np.bincount(src, minlength=30)).all() and (s != d).all()
    assert len(set(zip(s.tolist(), d.tolist(), strict=True))) == len(s) and not set(zip(s.tolist(), d.tolist(), strict=True)) == set(zip(src.tolist(), dst.tolist(), strict=True))


def block_graph(rng, n, k, inner, outer):
    truth = np.arange(n) % k
    a, b = np.triu_indices(n, 1)
    keep = rng.random(len(a)) < np.where(truth[a] == truth[b], inner, outer)
    a, b = a[keep], b[keep]
    return truth, np.concatenate([a, b]), np.concatenate([b, a])


def test_network_methods_recover_a_block_graph():
    truth, src, dst = block_graph(np.random.default_rng(8), 180, 3, 0.2, 0.02)
    w = np.ones(len(src))
    assert stats.plain_ari(truth, clustering.modularity_labels(180, src, dst, w)) > 0.9
    assert stats.plain_ari(truth, clustering.spectral_labels(180, src, dst, w, 3)) > 0.9
    noise = np.random.default_rng(9).standard_normal((180, 3))
    for distance in ("cosine", "euclidean"):
        found = clustering.Kefrin(3, distance, rho=0.0, runs=10, seed=1).fit(noise, src, dst, w)
        assert stats.plain_ari(truth, found) > 0.9
    shifted = noise + 6 * np.eye(3)[truth]
    assert stats.plain_ari(truth, clustering.Kefrin(3, "manhattan", xi=0.1, runs=10).fit(shifted, src, dst, w)) > 0.9


def test_both_sources_complement_each_other():
    """Features tell type 0 from the others, the network tells 1 from 2."""
    rng = np.random.default_rng(0)
    truth = np.repeat(np.arange(3), 100)
    x = rng.standard_normal((300, 4))
    x[truth == 0, :2] += 3
    a, b = np.triu_indices(300, 1)
    keep = rng.random(len(a)) < np.where((truth[a] == truth[b]) & (truth[a] > 0), 0.15, 0.03)
    a, b = a[keep], b[keep]
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a))
    both = clustering.Kefrin(3, "euclidean", xi=4.0, runs=20, seed=2).fit(x, src, dst, w)
    alone = clustering.Kefrin(3, "euclidean", xi=0.0, runs=20, seed=2).fit(x, src, dst, w)
    assert stats.plain_ari(truth, both) > 0.9 and stats.plain_ari(truth, alone) < 0.7


def test_kefrin_is_exact_in_an_easy_case():
    truth, src, dst = block_graph(np.random.default_rng(0), 240, 3, 0.3, 0.01)
    x = np.eye(3)[truth] * 3 + np.random.default_rng(3).standard_normal((240, 3)) * 0.3
    model = clustering.Kefrin(3, runs=5, seed=0)
    assert stats.plain_ari(truth, model.fit(x, src, dst, np.ones(len(src)))) == 1 and model.rounds < 100


def test_kefrin_algebra_matches_dense_rows():
    rng = np.random.default_rng(11)
    _, src, dst = block_graph(rng, 40, 2, 0.4, 0.1)
    w = rng.random(len(src) // 2)
    w = np.concatenate([w, w])
    model = clustering.Kefrin(3, "euclidean", runs=1)
    labels = model.fit(rng.standard_normal((40, 3)), src, dst, w)
    a = np.zeros((40, 40))
    a[src, dst] = w
    p = a - np.outer(a.sum(axis=1), a.sum(axis=0)) / a.sum()
    assert model.row2 == pytest.approx((p**2).sum(axis=1)) and model._rows(np.array([3, 7])) == pytest.approx(p[[3, 7]])
    c, lam = model._means(labels)
    assert lam == pytest.approx(np.stack([p[labels == k].mean(axis=0) for k in range(3)]))
    dense = ((model.y[:, None] - c) ** 2).sum(axis=2) + model.xi_used * ((p[:, None] - lam) ** 2).sum(axis=2)
    assert model._distances(c, lam) == pytest.approx(dense)


def test_ward_merges_the_cheapest_first():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    assert stats.plain_ari(np.array([0, 0, 1, 1, 2]), clustering.ward_labels(x, 3)) == 1
    assert len(set(clustering.ward_labels(x, 1))) == 1 and len(set(clustering.ward_labels(x, 5))) == 5


def _ward_by_hand(x, k):
    parts = [[i] for i in range(len(x))]
    sse = lambda p: ((x[p] - x[p].mean(axis=0)) ** 2).sum()
    while len(parts) > k:
        _, i, j = min((sse(a + b) - sse(a) - sse(b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        parts = [p for m, p in enumerate(parts) if m not in (i, j)] + [parts[i] + parts[j]]
    return parts


def test_ward_equals_plain_merging_with_copies():
    rng = np.random.default_rng(15)
    x = rng.standard_normal((40, 3))
    x[30:] = x[3]
    for k in (1, 2, 5, 30):
        labels = clustering.ward_labels(x, k, cells=64)
        assert {tuple(np.flatnonzero(labels == g)) for g in set(labels)} == {tuple(sorted(p)) for p in _ward_by_hand(x, k)}


def test_methods_on_the_driver_take_more_than_twenty_thousand_nodes(spark):
    n = 20_400
    nodes = spark.range(n).select(F.col("id").alias("node"), F.array(F.pmod("id", F.lit(3)).cast("double") * 10, F.sin("id") * 1e-3).alias("x"))
    step = lambda d: spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + d, F.lit(n)).alias("dst"), F.lit(1.0).alias("weight"))
    edges = step(3).unionByName(step(n - 3)).unionByName(step(1).where("src = 0 or src = 1")).unionByName(step(n - 1).where("dst = 0 or dst = 1"))
    for method in ("ward", "leiden", "kefrin"):
        found = clustering.run(method, nodes, 3, edges, **({"runs": 1} if method == "kefrin" else {}))
        assert found.count() == n
    ward = clustering.run("ward", nodes, 3).groupBy("label").agg(F.countDistinct(F.pmod("node", F.lit(3))).alias("k"), F.count("node").alias("n")).collect()
    assert [(r["k"], r["n"]) for r in ward] == [(1, n // 3)] * 3


def test_modularity_equals_its_definition():
    _, src, dst = block_graph(np.random.default_rng(12), 60, 3, 0.3, 0.05)
    w = np.ones(len(src))
    labels = np.arange(60) % 3
    a = np.zeros((60, 60))
    a[src, dst] = 1
    k, m2 = a.sum(axis=1), a.sum()
    assert stats.weighted_modularity(labels, src, dst, w) == pytest.approx(((a - np.outer(k, k) / m2) * (labels[:, None] == labels)).sum() / m2)


def test_warped_similarity_keeps_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = {i: rng.standard_normal(6 if i < 9 else 7) for i in range(15)}
    kept = []
    held = stats.checkpointed
    monkeypatch.setattr(stats, "checkpointed", lambda df: kept.append(df.count()) or held(df))
    found = stats.dtw_similarity(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node long, x array<double>"))
    z = {i: (v - v.mean()) / v.std(ddof=1) for i, v in x.items()}
    d = {(i, j): stats.dtw(z[i][None], z[j][None])[0, 0] for i in x for j in x if i < j and len(x[i]) == len(x[j])}
    scale = np.median(list(d.values()))
    want = {p: math.exp(-v / scale) for (i, j), v in d.items() for p in ((i, j), (j, i))}
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == pytest.approx(want)
    assert max(kept) <= len(x)


def test_warping_distance():
    a = np.array([0.0, 1.0, 2.0, 1.0, 0.0, 0.0])
    far = lambda x, y, *w: float(stats.dtw(x[None], y[None], *w)[0, 0])
    assert far(a, a) == 0 and far(a, np.roll(a, 1)) < np.linalg.norm(a - np.roll(a, 1))
    assert far(a, a + 1, 1) == pytest.approx(math.sqrt(6))
    both = stats.dtw(np.stack([a, np.roll(a, 1)]), np.stack([a + 1, a, a * 2]))
    assert both.shape == (2, 3) and both[1, 1] == far(np.roll(a, 1), a) and both[0, 2] == far(a, a * 2)


@pytest.mark.parametrize("block", [4096, 7])
def test_blocked_pairs_equal_all_pairs(spark, monkeypatch, block):
    from nodeloom.operators import pairs

    monkeypatch.setattr(pairs, "STRIP", 40)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 3))
    x[5] = x[6] = x[30]  # ties
    x[9] = 0
    group = rng.integers(0, 3, 40)
    v = spark.createDataFrame([(i, int(g), r.tolist()) for i, (g, r) in enumerate(zip(group, x, strict=True))] + [(99, 0, None)], "node long, label long, x array<double>")
    every = {(r["src"], r["dst"]): r["weight"] for r in pairs.every(v, pairs.squared_distance, block=block).collect()}
    assert len(every) == 40 * 39 // 2
    assert all(d == pytest.approx(((x[a] - x[b]) ** 2).sum(), abs=1e-9) for (a, b), d in every.items())
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    w = np.round((1 + (x / norm[:, None]) @ (x / norm[:, None]).T) / 2, 9)
    for by, unlike in ((None, None), (["label"], None), (None, "label")):
        got = {(r["src"], r["place"]): r["dst"] for r in pairs.nearest(v, 4, by=by, unlike=unlike, block=block).collect()}
        for i in range(40):
            others = [j for j in range(40) if j != i and (not by or group[i] == group[j]) and (not unlike or group[i] != group[j])]
            assert [got[i, p + 1] for p in range(min(4, len(others)))] == sorted(others, key=lambda j: (-w[i, j], j))[:4]
    sums = {(r["node"], r["other"]): (r["total"], r["n"]) for r in pairs.distance_sums(v.withColumn("labels", F.array("label")), block=block).collect()}
    for i in range(40):
        for g in range(3):
            mine = [j for j in range(40) if group[j] == g and j != i]
            assert sums[i, g] == (pytest.approx(sum(np.linalg.norm(x[i] - x[j]) for j in mine)), len(mine))


@pytest.mark.parametrize("n", [1, 2, 41])
def test_quantiles_over_pairs_are_exact(spark, n):
    from nodeloom.operators import pairs

    rng = np.random.default_rng(12)
    x = np.round(rng.standard_normal((n, 3)), 1)
    x[n // 2 :, 0] = np.nan
    x[: n // 2, 1:] = np.nan  # the halves share no cell
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "node long, x array<double>")
    got, values = pairs.quantiles(v, [0.0, 0.5, 0.95, 1.0], panel.shared_product, block=16)
    want = np.array([max(np.nansum(x[i] * x[j]), 0) for i in range(n) for j in range(i) if (~np.isnan(x[i] + x[j])).any()])
    assert got == len(want)
    assert values == pytest.approx(np.quantile(want, [0.0, 0.5, 0.95, 1.0]).tolist()) if len(want) else all(math.isnan(q) for q in values)


def test_pairs_leave_a_task_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from nodeloom.operators import pairs

    monkeypatch.setattr(pairs, "_dealt", lambda *a: type("G", (), {"groupBy": lambda self, *k: type("A", (), {"applyInArrow": lambda self, f, schema: f})()})())
    run = pairs.every(None, pairs.product)
    n = 1500
    batch = pa.RecordBatch.from_pydict({"node": np.arange(n), "x": list(np.ones((n, 2))), "_side": np.zeros(n, int), "_lo": np.zeros(n, int), "_hi": np.zeros(n, int)})
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= pairs.ROWS < sum(sizes)


def test_mixture_uses_every_component_and_finds_planted_groups(spark):
    rng = np.random.default_rng(1)
    truth = np.arange(300) % 3
    x = rng.standard_normal((300, 12)) * 0.5
    x[:, 11] += 4.0 * truth  # only the last component tells the groups apart
    x[:, 3] = 1.0  # a constant component needs the floor
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, x array<double>").repartition(3)
    got = {r["node"]: r["label"] for r in clustering.gaussian_mixture(v, 3, runs=2).collect()}
    assert stats.plain_ari(truth, np.array([got[i] for i in range(300)])) > 0.95


def test_leading_vectors_are_those_of_the_dense_matrix():
    rng = np.random.default_rng(2)
    a = np.triu((rng.random((90, 90)) < 0.2) * rng.random((90, 90)), 1)
    a += a.T
    src, dst = np.nonzero(a)
    scale = 1 / np.sqrt(a.sum(axis=1))
    _, want = np.linalg.eigh(a * scale[:, None] * scale)
    got = clustering.leading_vectors(90, src, dst, a[src, dst], 4)
    assert np.abs(got.T @ want[:, -4:]) == pytest.approx(np.eye(4), abs=1e-6)


def test_components_and_types(spark):
    edges = edge_frame(spark, [(0, 1, 1), (1, 2, 1), (3, 4, 1), (2, 3, 1)])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)], "node long, label long")
    assert dict(rows(graph.components(edges, labels), "node", "component")) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    assert rows(graph.type_components(edges, labels), "label", "n_nodes", "n_components", "largest_share") == [(0, 3, 1, 1.0), (1, 3, 2, pytest.approx(2 / 3))]


def test_selection_ranks_by_six_indices_and_chooses_the_planted_partition(spark):
    from nodeloom.operators import selection

    rng = np.random.default_rng(8)
    truth = np.arange(90) % 3
    x = rng.standard_normal((90, 2)) * 0.3 + np.array([[0, 0], [5, 0], [0, 5]])[truth]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, x array<double>")
    pairs_ = [(i, j, 1.0) for i in range(90) for j in range(i) if truth[i] == truth[j] and rng.random() < 0.3 or rng.random() < 0.01]
    edges = edge_frame(spark, pairs_)
    frame = lambda name, values: [(name, i, int(c)) for i, c in enumerate(values)]
    labels = spark.createDataFrame(frame("true", truth) + frame("random", rng.integers(0, 3, 90)) + frame("lump", np.arange(90) > 5), "candidate string, node long, label long")
    found = {r["candidate"]: r for r in selection.evaluate(labels, v, edges).collect()}
    for name in ("true", "random"):
        own = labels.where(F.col("candidate") == name).select("node", "label")
        with_x = v.join(own, "node")
        assert found[name]["ch"] == pytest.approx(indices.calinski_harabasz(with_x).first()[0]) and found[name]["s_dbw"] == pytest.approx(indices.s_dbw(with_x).first()[0])
        assert found[name]["sw"] == pytest.approx(indices.silhouette(with_x).agg(F.avg("sw")).first()[0])
        row = indices.network_indices(edges, own).first()
        assert [found[name][c] for c in ("avi", "avu", "mq")] == pytest.approx([row["avi"], row["avu"], row["mq"]])
    assert [r["candidate"] for r in selection.ranked(selection.evaluate(labels, v, edges), 90, 24).orderBy("borda_place").collect()] == ["true", "random"]
    grid = selection.grid(spark, [3], ["net"], [1.0], ["cosine"], [1.0], ("kmeans", "ward"))
    assert grid.count() == 6 and grid.where("candidate = 'kefrin|net|k3|cosine|x1.0'").count() == 1

    def cluster(row, some, seed):
        return selection.labels_of(row, some, {"net": graph.restrict(edges, some)}, runs=2)

    table, best = selection.select(grid.where("method IN ('kmeans', 'ward')"), cluster, v, {"net": edges}, "net", top=1, runs=2)
    assert best.first()["stability"] == pytest.approx(1.0) and table.where("stability IS NOT NULL").count() == 1


def test_yearly_comovement_sums_its_cells_once(spark):
    from nodeloom.plans import composite_queries

    found = composite_queries.yearly_comovement(spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "lineitem" in f or "part.parquet" in f]


def test_community_strength_takes_all_null_graphs(spark, monkeypatch):
    from nodeloom.plans import model_queries

    drawn = []
    permuted = stats._permuted
    monkeypatch.setattr(stats, "_permuted", lambda session, seeds, *rest: drawn.append(seeds) or permuted(session, seeds, *rest))
    found = model_queries.community_strength(spark, "/root/testdata/sf0.001").first()
    assert drawn == [20] and found["excess"] > 0


def test_communities_do_not_depend_on_the_order_of_edges():
    _, src, dst = block_graph(np.random.default_rng(8), 180, 3, 0.2, 0.05)
    w = np.random.default_rng(9).random(len(src) // 2).repeat(2).reshape(-1, 2).T.reshape(-1)
    order = np.random.default_rng(10).permutation(len(src))
    assert (clustering.modularity_labels(180, src, dst, w) == clustering.modularity_labels(180, src[order], dst[order], w[order])).all()
    assert len(clustering.modularity_labels(4, src[:0], dst[:0], w[:0])) == 4 and len(clustering.modularity_labels(0, src[:0], dst[:0], w[:0])) == 0


def shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(held.size()) if (f := held.apply(i).getName()).startswith("shuffle_")}


def test_written_steps_and_passes_over_pairs_leave_no_shuffle_files(spark):
    from nodeloom.operators import pairs
    from nodeloom.sources.storage import checkpointed

    before = shuffle_files(spark)
    held = checkpointed(spark.range(100).groupBy((F.col("id") % 10).alias("node")).agg(F.array(F.sum("id").cast("double"), F.max("id").cast("double")).alias("x")))
    assert pairs.quantiles(held, [0.5])[0] == 45
    assert shuffle_files(spark) <= before


def test_comovement_is_dealt_from_written_vectors(spark):
    rows_ = spark.createDataFrame([(n, 1, c, float(n * c)) for n in range(4) for c in range(3)], "node long, year long, category long, u double").withColumn("period", F.lit(1)).withColumn("u", F.col("u") - F.avg("u").over(Window.partitionBy("node")))
    plan = panel.comovement(rows_, ["year"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_best_columns_are_the_top_of_all_rounded_cells_and_few_are_ordered(monkeypatch):
    from nodeloom.operators import pairs

    rng = np.random.default_rng(11)
    spread, ties = rng.random((40, 1003)), rng.integers(0, 4, (40, 1003)) + rng.random((40, 1003)) * 1e-10
    barred = np.where(rng.random((40, 1003)) < 0.995, -np.inf, spread)
    cut = lambda r, c: sorted(zip(r.tolist(), c.tolist(), strict=True))
    wanted = [[cut(*pairs.top_columns(np.round(w, 9), k)) for k in (1, 10, 64, 70)] for w in (spread, ties, barred)]
    assert [[cut(*pairs.best_columns(w, k, 9)) for k in (1, 10, 64, 70)] for w in (spread, ties, barred)] == wanted
    monkeypatch.setattr(pairs, "top_columns", None)  # not all cells are ordered
    assert cut(*pairs.best_columns(spread, 10, 9)) == wanted[0][1]
