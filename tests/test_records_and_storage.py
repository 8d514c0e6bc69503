"""Records, versions, dynamics, concepts and storage against small examples."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import analogs, concepts, dynamics, records
from nodeloom.sources import storage


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def yearly(spark, values):
    return spark.createDataFrame([(1, y, float(v)) for y, v in values], "node long, year long, value double")


def test_population_is_the_mean_of_annual_means(spark):
    means = records.annual_mean(yearly(spark, [(1, 1000), (2, 1200), (3, 1200)]), "node", "year", "value").where("year IN (1, 2)")
    assert records.mean_of_years(means, "node").first()["value"] == 1150
    assert rows(means, "year", "approximate") == [(1, False), (2, False)]


def sectors(spark, cells):
    return spark.createDataFrame([(1, y, s, g, float(v)) for y, s, g, v in cells], "node long, year long, section string, grp string, value double")


def test_sector_shares_pool_years_that_balance(spark):
    cells = [(1, "A", "farm", 80), (2, "A", "farm", 20), (1, "C", "make", 20), (2, "O", "state", 80)]
    got = records.balanced_sectors(sectors(spark, cells), yearly(spark, [(1, 100), (2, 100)]), "node", "year", "grp")
    assert rows(got, "grp", "share") == [("farm", 0.5), ("make", 0.1), ("state", 0.4)]
    over = records.balanced_sectors(sectors(spark, [(1, "A", "farm", 120), (2, "A", "farm", 20)]), yearly(spark, [(1, 100), (2, 100)]), "node", "year", "grp")
    assert rows(over, "share") == [(0.2,)]
    rounding = records.balanced_sectors(sectors(spark, [(1, "A", "farm", 100.5)]), yearly(spark, [(1, 100)]), "node", "year", "grp")
    assert records.unallocated(rounding, "node").first()["unallocated"] == 0


def shops(spark, cells):
    return spark.createDataFrame([(1, 1, 1, k, float(v)) for k, v in cells], "node long, year long, quarter long, kind string, value double")


def test_retail_counts_subtypes_once_and_never_rebuilds_totals(spark):
    people = yearly(spark, [(1, 1100)])
    args = ("node", "year", "quarter", "shops", ["super"], ["super", "other"])
    row = records.retail(shops(spark, [("shops", 10), ("super", 6), ("other", 4), ("kiosks", 5)]), people, *args).first()
    assert row["modern_share"] == pytest.approx(0.6) and row["retail_per_1000"] == pytest.approx(15 / 1100 * 1000)
    assert records.retail(shops(spark, [("super", 6)]), people, *args).count() == 0


def test_urban_zero_is_structural_only_where_rural_is_all(spark):
    frame = lambda *v: spark.createDataFrame([(n, 1, float(x)) for n, x in v], "node long, year long, value double")
    got = records.urban_share(frame((3, 40)), frame((1, 100), (2, 60), (3, 60)), frame((1, 100), (2, 100), (3, 100)), "node", "year")
    assert rows(got, "node", "share_urban", "urban_status") == [(1, 0.0, "structural zero"), (2, None, "no data"), (3, 0.4, "observed")]


def test_outliers_need_both_neighbours(spark):
    got = records.single_outliers(yearly(spark, [(1, 500), (2, 100), (3, 1000), (4, 110), (5, 400)]), "node", "year", "value")
    assert rows(got.where("outlier"), "year") == [(2,), (3,), (4,)]
    steps = records.single_outliers(yearly(spark, [(1, 100), (2, 200), (3, 210)]), "node", "year", "value")
    assert steps.where("outlier").count() == 0


def test_imputation_prefers_the_region(spark):
    df = spark.createDataFrame([(1, "r", "t", 1.0), (2, "r", "t", 3.0), (3, "r", "t", None), (4, "q", "t", None), (5, "q", "u", None)], "id long, region string, kind string, v double")
    assert rows(records.imputed(df, "v", "region", "kind"), "id", "v", "imputed") == [(1, 1.0, False), (2, 3.0, False), (3, 2.0, True), (4, 2.0, True), (5, None, True)]


def test_versions_fall_back_and_say_so(spark):
    versions = spark.createDataFrame([("a", 2000, 2010, 1), ("a", 2010, 2020, 2), ("s", 1990, 9999, 7)], "code string, y0 int, y1 int, node long")
    keys = spark.createDataFrame([("a", "s", 2009), ("a", "s", 2010), ("a", "s", 2030), ("b", "s", 2001), ("b", "z", 2001), (None, None, None)], "code string, stable string, year int")
    got = records.versioned(keys, versions, "code", "year", "y0", "y1", "node", "stable")
    assert rows(got, "code", "stable", "year", "node", "rule") == sorted(
        [("a", "s", 2009, 1, "version"), ("a", "s", 2010, 2, "version"), ("a", "s", 2030, 1, "code"), ("b", "s", 2001, 7, "stable"), ("b", "z", 2001, None, None), (None, None, None, None, None)], key=repr
    )


def test_weighted_mean_equals_its_sql_on_zero_and_null_weights(spark, tmp_path):
    import datetime
    import math

    import duckdb

    from nodeloom.plans import catalogue

    day = lambda d: datetime.datetime(2024, 1, d)
    cells = [(1, 1, 0.0), (2, 1, 2.0), (7, 2, None), (3, 2, 3.0), (6, 3, None), (10, 4, None), (11, 4, 1.0), (12, 5, 0.5)]
    events = [(e, day(1 + e % 3), n, "click", w, '{"k": %d}' % (e * 7)) for e, n, w in cells]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["node"]: r["value"] for r in catalogue.QUERIES["weighted_mean"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[1] for r in db.execute(f"SELECT node, value FROM ({catalogue.ORACLES['weighted_mean']})").fetchall()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
    assert math.isnan(got[1]) and got[3] is None and got[2] == 21


def test_sums_with_a_least_count(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(records.min_count_sum(["a", "b", "c"], 2)).collect()] == [3.0, None, None]
    assert [r[0] for r in df.select(records.min_count_sum(["a", "b", "c"], 1)).collect()] == [3.0, 3.0, None]


def labels(spark, series):
    return spark.createDataFrame([(n, p, v) for n, vs in series.items() for p, v in enumerate(vs)], "node long, period long, label long")


def test_trajectories_and_modes(spark):
    df = labels(spark, {1: [0] * 8, 2: [0] * 7 + [1], 3: [0] * 4 + [1] * 4, 4: [0, 1] * 4})
    assert dict(rows(dynamics.trajectories(df), "node", "trajectory")) == {1: "stable", 2: "fluctuation", 3: "persistent shift", 4: "fluctuation"}
    years = labels(spark, {1: [0, 1, 1, 0, 5, 5, 6, 6], 2: [1, 2, 3, 4, 2, 2, 2, 3]}).withColumn("year", F.expr("period div 4"))
    assert rows(dynamics.mode_last(years, ["node", "year"]), "node", "year", "mode") == [(1, 0, 0), (1, 1, 6), (2, 0, 4), (2, 1, 2)]


def test_network_term_can_decide_the_nearest_centre(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.5])], "node long, x array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label long, centre array<double>")
    assert rows(dynamics.nearest_centre(v, c), "node", "assigned") == [(1, 0), (2, 0)]
    term = spark.createDataFrame([(2, 0, 1.0), (2, 1, 0.0)], "node long, label long, term double")
    assert rows(dynamics.nearest_centre(v, c, extra=term), "node", "assigned") == [(1, 0), (2, 1)]


def test_concepts_of_a_small_context(spark):
    # objects 110, 110, 101, 001 over attributes a (bit 0), b, c
    masks = spark.createDataFrame([(0, 0b011), (1, 0b011), (2, 0b101), (3, 0b100)], "node long, mask long")
    sets = concepts.combos(spark, 3)
    found = concepts.concepts(masks, sets, 1)
    assert rows(found, "intent", "extent") == [(0b001, 3), (0b011, 2), (0b100, 2), (0b101, 1)]
    assert dict(rows(concepts.delta(masks, found, 3), "intent", "delta"))[0b001] == 1
    assert dict(rows(concepts.generators(masks, sets, 1), "intent", "generator"))[0b011] == 0b010
    described = concepts.describe(masks, spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "node long, label long"), sets, 1)
    assert rows(described.where("place = 1"), "label", "intent", "precision", "coverage") == [(0, 0b100, 1.0, 1.0), (1, 0b011, 1.0, 1.0)]


def test_analogs_put_the_own_group_first(spark):
    v = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(6)], "node long, label long, x array<double>")
    assert rows(analogs.analogs(v, 3, first="label").where("src = 0"), "place", "dst") == [(1, 2), (2, 4), (3, 1)]
    assert rows(analogs.analogs(v, 3, same="label").where("src = 1"), "place", "dst") == [(1, 3), (2, 5)]


def test_swapped_rows_differ_and_noise_does_not(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "id long, v double")
    swapped = spark.createDataFrame([(1, 20.0), (2, 10.0), (3, None)], "id long, v double")
    noisy = a.withColumn("v", F.col("v") * (1 + 1e-12))
    assert rows(storage.table_diff(a, swapped, ["id"], ["v"]), "id", "state") == [(1, "differs"), (2, "differs")]
    assert storage.table_diff(a, noisy, ["id"], ["v"]).count() == 0
    assert rows(storage.table_diff(a, a.where("id > 1"), ["id"], ["v"]), "id", "state") == [(1, "only in a")]
    one, two = ('{"a": [1, 2.000000000001], "b": {}, "c": null}', '{"c": null, "b": {}, "a": [1, 2.0]}')
    table = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    assert storage.json_diff(table(one, None, "not json"), table(two, None, "not json"), ["k"], "j").count() == 0
    found = storage.json_diff(table('{"a": true, "b": [1]}', "[]", "1"), table('{"a": 1, "b": [1, 2]}', "{}", None), ["k"], "j")
    assert sorted(map(tuple, found.collect())) == [(0, '$["a"]', "differs"), (0, '$["b"][1]', "only in b"), (1, "$", "differs"), (2, "$", "only in a")]


def test_archives_are_filtered_while_they_are_read(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("part/x_2023.csv", "﻿code;value;more\nA;1;q\nB;2;q\n")
        z.writestr("part/x_9999.csv", "code;value\nA;3\n")
        z.writestr("part/x_2019.csv", "code;value\nA;4\n")
        z.writestr("other/x_2023.csv", "code;value\nA;5\n")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    got = storage.archived_csv(spark, str(tmp_path / "*.zip"), ["code", "value", "absent"], "part/", ".csv", {2023}, where=("code", "A|C"))
    assert rows(got, "member", "code", "value", "absent") == [("part/x_2023.csv", "A", "1", None), ("part/x_9999.csv", "A", "3", None)]


def test_manifest_finds_what_changed(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.txt").write_text(name)
    saved = storage.checksums(spark, str(folder)).collect()
    expected = {r["file"]: r["sha256"] for r in saved}
    storage.check_inputs(spark, str(folder), expected)
    (folder / "a.txt").write_text("changed")
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("d")
    now = storage.manifest_diff(storage.checksums(spark, str(folder)), spark.createDataFrame(saved))
    assert rows(now, "file", "state") == [("a.txt", "changed"), ("b.txt", "missing"), ("d.txt", "new")]
    with pytest.raises(ValueError, match="differ"):
        storage.check_inputs(spark, str(folder), expected)


def test_writers(spark, tmp_path):
    df = spark.range(3)
    storage.write_once(df, str(tmp_path / "p"))
    storage.write_once(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    storage.write_report(df, str(tmp_path / "c"))
    storage.write_report(df, str(tmp_path / "j"), "json")
    assert len(list((tmp_path / "c").glob("*.csv"))) == len(list((tmp_path / "j").glob("*.json"))) == 1
    assert storage.projected(spark, str(tmp_path / "p"), ["id"], F.col("id") > 1).count() == 1
