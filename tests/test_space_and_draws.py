"""Joins on the whole sphere, masks of several radars, thresholds that values equal, stations' years, and drawn samples."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeworks.operators import resampling as B
from galeworks.operators import skill as K
from galeworks.operators import spatial as S
from galeworks.operators import stormchain as H


def km(x, y):
    la, lo, lb, ob = (math.radians(v) for v in (*x, *y))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 6373.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("radius", [3.0, 60.0, 900.0, 9000.0, 21_000.0])
def test_radius_join_on_the_whole_sphere(spark, radius):
    r = np.random.default_rng(3)
    special = [(0.0, 179.95), (0.0, -179.95), (0.0, 180.0), (0.0, -180.0), (89.9, 0.0), (89.9, 170.0), (90.0, 12.0), (-90.0, 77.0), (-89.99, -100.0), (0.0, 0.0), (0.01, 0.01), (45.0, 359.0), (45.0, -1.0)]
    points = special + [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(r.uniform(-1, 1, 90))), r.uniform(-180, 180, 90), strict=True)]
    points += [(a + 0.01, b) for a, b in points[20:50]]
    one = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, None, 1.0)], "p long, lat double, lon double")
    two = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, 1.0, None)], "q long, lat double, lon double")
    rows = S.radius_join(one, two, radius).collect()
    assert sorted((x["p"], x["q"]) for x in rows) == sorted((i, j) for i, a in enumerate(points) for j, b in enumerate(points) if km(a, b) < radius)
    assert set(rows[0].asDict()) == {"p", "lat", "lon", "q", "lat_r", "lon_r", "distance"}


def test_storms_meet_points_of_their_own_grid(spark):
    r = np.random.default_rng(5)
    cells = [(int(g), int(s), int(u), int(i), int(j)) for g, s, u in r.integers(0, 3, (12, 3)) for i, j in r.integers(0, 40, (25, 2)) // (1, 2)]
    points = [(int(g), n, int(i), int(j)) for n, (g, i, j) in enumerate(zip(r.integers(0, 3, 40), r.integers(-5, 45, 40), r.integers(-5, 30, 40), strict=True))]
    masks = spark.createDataFrame(cells, "rid long, scan long, uid long, i long, j long")
    stations = spark.createDataFrame(points, "rid long, stn long, pi long, pj long")
    got = {tuple(x[c] for c in ("rid", "scan", "uid", "stn")): (x["near"], x["in0"], x["in5"]) for x in S.storm_within(masks, stations, [0, 5], ("scan", "uid"), "stn", ("rid",)).collect()}
    want = {}
    for g, s, u, i, j in cells:
        for h, n, a, b in points:
            d = math.hypot(i - a, j - b)
            if g == h and d <= 5:
                want[g, s, u, n] = min(d, want.get((g, s, u, n), 99.0))
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], d) and got[k][1:] == (int(d == 0), 1) for k, d in want.items())
    runs = S.mask_runs(spark.createDataFrame([(1, i, j) for i, j in ((0, 0), (0, 1), (0, 3), (1, 1), (1, 1), (3, 4), (3, 5))], "uid long, i long, j long"), ["uid"]).first()
    assert [tuple(x) for x in runs["runs"]] == [(0, 0, 1), (0, 3, 3), (1, 1, 1), (3, 4, 5)] and (runs["i0"], runs["i1"], runs["j0"], runs["j1"]) == (0, 3, 0, 5)


def test_best_storm_prefers_those_inside(spark):
    rows = [(1, 7, 10, 50.0, True), (1, 7, 11, 60.0, False), (1, 7, 12, 50.0, True), (2, 7, 13, 1.0, False), (2, 7, 14, None, None), (3, 7, 15, None, True)]
    near = spark.createDataFrame(rows, "scan long, stn long, uid long, x double, close boolean")
    got = {r["scan"]: (r["uidA"], r["inA"], r["uidB"], r["inB"]) for r in S.best_storm(near, ["scan", "stn"], {"A": F.col("close"), "B": F.lit(True)}, "x", "uid").collect()}
    assert got == {1: (10, 1, 11, 1), 2: (13, 0, 13, 1), 3: (15, 1, 15, 1)}


def test_select_stations(spark):
    stations = spark.createDataFrame([(1, 0.0, 0.0, 2000, 2010), (2, 0.0, 0.1, 2000, 2005), (3, 0.0, 0.2, 2011, 2020), (4, 0.0, 0.3, 2010, 2010), (5, 0.0, 9.0, 2000, 2020), (6, 0.0, 0.0, 2000, None)], "stn_no long, lat double, lon double, y1 int, y2 int")
    radars = spark.createDataFrame([(9, 0.0, 0.0)], "rid long, lat0 double, lon0 double")
    chosen = lambda **more: sorted(r["stn_no"] for r in S.select_stations(stations, radars, 100, **more).collect())
    assert chosen(year=2010) == [1, 4] and chosen() == [1, 2, 3, 4, 6] and chosen(year=2010, exclude=F.col("stn_no") == 1) == [4] and chosen(wanted=[2, 5]) == [2]
    with pytest.raises(ValueError):
        chosen(wanted=[5])


def test_extremes(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 10.0), (1, 2, -9.0, 400.0), (1, 3, 5.0, 900.0), (2, 1, None, 1.0)], "k long, i long, v double, distance double")
    assert [tuple(r) for r in S.extreme_point(df, ["k"], F.col("v"), ["i"], ["distance"]).collect()] == [(1, 5.0, 10.0)]
    assert [tuple(r) for r in S.extreme_point(df, ["k"], F.col("v"), ["i"], [], size=True).collect()] == [(1, -9.0)]
    assert sorted(map(tuple, S.radius_extremes(df, ["k"], F.col("v"), [500]).collect())) == [(1, 5.0, -9.0, 9.0), (2, None, None, None)]


@pytest.mark.parametrize("top", [37.31, 1e-3, 1 / 3, 12_345.678, 0.7])
def test_values_equal_to_a_threshold_do_not_exceed_it(spark, top):
    steps = 100
    limits = [k * top / (steps - 1) for k in range(steps)]
    values = limits + [np.nextafter(x, 1e9) for x in limits] + [np.nextafter(x, -1.0) for x in limits] + [-1.0, 2 * top]
    df = spark.createDataFrame([(k % 2, float(x), 1 + k % 3) for k, x in enumerate(values)], "event int, x double, w long")
    for weight in (None, "w"):
        got = {r["step"]: (r["threshold"], r["hits"], r["false_alarms"]) for r in K.threshold_sweep(df, [], "event", "x", steps, top, weight).collect()}
        for k, limit in enumerate(limits):
            size = lambda e: sum((1 + i % 3 if weight else 1) for i, x in enumerate(values) if i % 2 == e and x > limit)  # noqa: B023, E731
            assert got[k] == (limit, size(1), size(0))


def test_drawn_counts_are_poisson(spark):
    df = spark.createDataFrame([(i, c) for i in range(300) for c in (0, 1, 3, 40)], "id long, n long")
    drawn = B.drawn_counts(df, {"d": ("n", 1.0), "half": ("n", 0.5)}, ["id", "n"], 50).toPandas()
    for c in (1, 3, 40):
        for name, mean in (("d", c), ("half", c / 2)):
            x = np.zeros(15_000)
            own = drawn[drawn.n == c][name].to_numpy()
            x[: len(own)] = own
            assert abs(x.mean() - mean) < 5 * math.sqrt(mean / len(x)) and abs(x.var() / mean - 1) < 0.06
    assert not (drawn.n == 0).any()
    wide = drawn[drawn.n == 40].pivot(index="id", columns="replicate", values="d").fillna(0).to_numpy()
    assert abs(np.corrcoef(wide.T) - np.eye(50)).max() < 0.3 and abs(np.corrcoef(wide[:100]) - np.eye(100)).max() < 0.65


def test_the_mean_of_weighted_rows_spreads_as_it_should(spark):
    """Also for a value that follows from the row's last digit."""
    df = spark.range(4000).withColumn("x", (F.col("id") % 10).cast("double"))
    sums = B.bootstrap_rows(df, "id", 300).groupBy("replicate").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"), F.sum("weight").alias("w")).toPandas()
    assert 0.8 < sums.m.std() / (math.sqrt(8.25) / math.sqrt(4000)) < 1.2 and 0.8 < sums.w.std() / math.sqrt(4000) < 1.2 and abs(sums.w.mean() - 4000) < 20


def test_bootstrap_skill(spark):
    r = np.random.default_rng(9)
    rows = [(int(k), int(e), float(x)) for k, e, x in zip(r.integers(0, 2, 600), r.random(600) < 0.3, r.integers(0, 12, 600), strict=True)]
    rows = [(k, e, x + 4 * e if k else x - 4 * e + 4) for k, e, x in rows] + [(0, 1, None), (5, 1, 3.0)]
    df = spark.createDataFrame(rows, "k long, e int, x double")
    found = B.bootstrap_skill(df, ["k"], "e", "x", ["k", "x"], 200, 0.5).toPandas()
    plain = {r["k"]: r["auc"] for r in K.auc(df, ["k"], "e", "x", orient="mean").collect()}
    for k in (0, 1):
        own = found[found.k == k].score
        assert len(own) == 200 and abs(own.mean() - plain[k]) < 0.02 and 0.01 < own.std() < 0.05 and own.min() > 0.5
    assert found[found.k == 5].score.isna().all()
    best = B.bootstrap_skill(df, ["k"], "e", "x", ["k", "x"], 50, 1.0, "tss").toPandas()
    assert set(best.k) == {0, 1} and best[best.k == 1].score.between(0.1, 0.9).all() and best.threshold.between(0, 16).all()


def test_events_are_drawn_with_replacement(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(220)] + [(500, None)], "id long, e int")
    drawn = B.resample_events(df, ["id"], "e", 3, 20).toPandas()
    assert drawn.groupby(["replicate", "e"]).size().to_dict() == {(k, e): 20 if e else 220 for k in range(3) for e in (0, 1)}
    assert all(5 < own.id.nunique() < 20 for _, own in drawn[drawn.e == 1].groupby("replicate"))
    assert len({tuple(sorted(own.id)) for _, own in drawn[drawn.e == 1].groupby("replicate")}) == 3
    assert B.resample_events(df, ["id"], "e", 2, 5, share=0.25).where("e = 0").count() == 100
    assert B.resample_events(df.where("false"), ["id"], "e", 2, 5).count() == 0


def test_chain_follows_each_gust(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    masks = spark.createDataFrame([(1, 10, 1, 0, 0), (1, 10, 2, 30, 30), (1, 11, 1, 0, 9), (2, 10, 1, 0, 0)], "rid long, scan long, uid long, i long, j long")
    storms = spark.createDataFrame([(1, 10, at(0), 1, 40.0), (1, 10, at(0), 2, 50.0), (1, 11, at(6), 1, 45.0), (2, 10, at(3), 1, 60.0)], "rid long, scan long, scan_time timestamp_ntz, uid long, field_max double")
    points = spark.createDataFrame([(1, 7, 0, 0), (2, 8, 50, 50)], "rid long, stn_id long, pi long, pj long")
    gusts = spark.createDataFrame([(1, 7, at(1), 30.0, "Y"), (2, 7, at(6), 30.0, "Y"), (3, 7, at(7), 30.0, "Y"), (4, 8, at(3), 30.0, "Y"), (5, 7, at(2), 30.0, "N"), (6, 9, at(2), 30.0, "Y")], "event_id long, stn_id long, dt_utc timestamp_ntz, gust double, q string")
    got = {r["event_id"]: (r["scan"], r["uid10"], r["in10"], r["dist10"], r["uid0"], r["in0"]) for r in H.storms_of_gusts(masks, storms, points, gusts, H.ChainRules()).collect()}
    assert got == {1: (10, 1, 1, 0.0, 1, 1), 2: (11, 1, 1, 9.0, 1, 0), 4: (10, 1, 0, None, 1, 0)}


def test_a_rerun_replaces_its_own_month_only(spark, tmp_path):
    from galeworks.sources import readers as R

    path = str(tmp_path / "merged")
    frame = lambda rows: spark.createDataFrame([(rid, dt.datetime(2024, m, 3), x) for rid, m, x in rows], "rid int, t timestamp_ntz, x double")
    R.write_merged(frame([(1, 1, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0)]), path, "t")
    R.write_merged(frame([(1, 1, 9.0)]), path, "t")
    assert sorted((r["rid"], r["month"], r["x"]) for r in spark.read.parquet(path).collect()) == [(1, 1, 9.0), (1, 2, 3.0), (2, 1, 4.0)]
    for value in (5.0, 6.0):
        R.write_event_tables({"scw_envs": frame([(1, 1, value)])}, str(tmp_path / "events"))
        R.publish(frame([(1, 1, value)]), {"rid": "radar", "x": "gust"}, ["radar"], str(tmp_path / "public"))
        R.restructure_by_year(frame([(1, 1, value)]).withColumn("state", F.lit("a")), str(tmp_path / "years"), "state", "t", [2024])
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "events" / "scw_envs")).collect()] == [6.0] == [r["x"] for r in spark.read.parquet(str(tmp_path / "years")).collect()]
    assert spark.read.csv(str(tmp_path / "public"), header=True).count() == 1


def test_bucketed_grids_join_where_they_lie(spark, tmp_path):
    from galeworks.sources import readers as R

    base = spark.range(600).select((F.col("id") % 5).alias("i"), (F.col("id") % 4).alias("j"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id as int))").alias("time"), "id")
    names = R.write_grid_tables({f"v{k}": base.select("i", "j", "time", (F.col("id") * k).cast("double").alias(f"v{k}")) for k in range(7)}, str(tmp_path / "grid"), ["i", "j"], "time", 3)
    at = lambda *t: F.make_timestamp_ntz(*map(F.lit, (*t, 0, 0)))
    found = R.load_grid_tables(spark, names, ["i", "j"], "time", at(2024, 1, 2, 0), at(2024, 1, 20, 0), [0, 12])
    rows = found.collect()
    assert len(rows) == 37 and all(r["v6"] == 2 * r["v3"] == 6 * r["v1"] for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")
