"""Operators against plain loops, and registered queries against their SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from galeworks import catalog
from galeworks.operators import cases as C
from galeworks.operators import grid as G
from galeworks.operators import models as M
from galeworks.operators import skill as K
from galeworks.operators import spatial as S
from galeworks.operators.events import decluster_forward
from galeworks.sources import readers as R

DIR = "/root/testdata/sf0.001"
TABLES = ["nation", "customer", "orders", "lineitem", "events"]


def naive_forward(rows, width):
    """The strongest row within `width` of each survivor in turn."""
    left, out = sorted(rows), []
    while left:
        t, i, x = left[0]
        near = [r for r in left if r[0] < t + width]
        best = max(near, key=lambda r: (r[2], -r[0], -r[1]))
        if best[2] <= x:
            out.append(left[0])
            left = [r for r in left if r[0] >= t + width]
        else:
            left = [best] + [r for r in left if r[0] >= t + width]
    return out


def test_decluster_forward(spark):
    r = np.random.default_rng(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(int(k % 6), int(t), i, float(r.integers(20, 40))) for i, (k, t) in enumerate(zip(r.integers(0, 6, 300), r.integers(0, 90_000, 300), strict=True))]
    df = spark.createDataFrame([(k, base + dt.timedelta(seconds=t), i, x) for k, t, i, x in rows], "rid long, t timestamp_ntz, id long, gust double")
    got = sorted((x["rid"], x["id"]) for x in decluster_forward(df, ["rid"], "t", "gust", "id", 3600).collect())
    want = sorted((k, i) for k in range(6) for _, i, _ in naive_forward([(t, i, x) for q, t, i, x in rows if q == k], 3600))
    assert got == want
    assert decluster_forward(df.where("false"), ["rid"], "t", "gust", "id").count() == 0


def test_auc(spark):
    r = np.random.default_rng(6)
    rows = [(int(e), float(v)) for e, v in zip(r.integers(0, 2, 200), r.integers(0, 30, 200), strict=True)] + [(1, None)]
    pos, neg = [v for e, v in rows if e and v is not None], [v for e, v in rows if not e]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = K.auc(spark.createDataFrame(rows, "scw int, x double"), [], "scw", "x").collect()[0]["auc"]
    assert math.isclose(got, want)


def test_radius_join_far_from_the_equator(spark):
    r = np.random.default_rng(8)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-75, 70, 150), r.uniform(100, 130, 150), strict=True))]
    a = spark.createDataFrame(pts, "p long, la double, lo double")
    b = spark.createDataFrame(pts, "q long, lat double, lon double")

    def km(x, y):
        la, lo, lb, ob = (math.radians(v) for v in (*x[1:], *y[1:]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
        return 2 * 6373.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    got = sorted((x["p"], x["q"]) for x in S.radius_join(a, b, 400, left_at=("la", "lo")).collect())
    assert got == sorted((x[0], y[0]) for x in pts for y in pts if km(x, y) < 400)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted(([row[i] for i in order] for row in found.fetchall()), key=str)
    got = sorted((list(r) for r in catalog.queries()[name](spark, DIR).select(columns).collect()), key=str)
    assert got == want


def test_readers_take_bad_text(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("hd, 1234,202401010059,202401010100, 12.5,Y,#\nhd,1234,x,2024,none,N,#\n")
    two.write_text("hd,1234,2024,1,1,0,5,2023,12,31,14,5,36.0,Y,#\n")
    got = R.read_raw_gusts(spark, str(one)).orderBy(*["dt_utc"]).collect()
    assert [tuple(r) for r in got] == [(None, 1234, None, None, "N"), (dt.datetime(2024, 1, 1, 1), 1234, dt.datetime(2024, 1, 1, 0, 59), 12.5, "Y")]
    assert [tuple(r) for r in R.read_raw_gusts(spark, str(two), layout=2).collect()] == [(dt.datetime(2023, 12, 31, 14, 5), 1234, dt.datetime(2024, 1, 1, 0, 5), 10.0, "Y")]
    (tmp_path / "strokes.csv").write_text("2024-01-01,10:00:30,-30.5,140.25,1,2,3,4,5\nbad,x,1,y,,,,,\n")
    strokes = sorted(map(tuple, R.read_strokes(spark, [], [str(tmp_path / "strokes.csv")]).collect()), key=str)
    assert strokes == [(None, 1.0, None), (dt.datetime(2024, 1, 1, 10, 0, 30), -30.5, 140.25)]
    for name in ("50_20240101_0000.zip", "50_20240103_0000.zip", "other.zip"):
        (tmp_path / "scans").mkdir(exist_ok=True)
        (tmp_path / "scans" / name).write_bytes(b"x")
    import pyspark.sql.functions as F

    found = R.discover_by_filename(spark, str(tmp_path / "scans"), r"_(\d{8}_\d{4})", "yyyyMMdd_HHmm", F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 1, 2)))
    assert [r["path"].rpartition("/")[2] for r in found.collect()] == ["50_20240101_0000.zip"]


def test_multisensor_and_fixed_width(spark, tmp_path):
    line = ["HD01D", "1234", "202401010000", "202401010001", "0.2"] + ["x"] * 16 + ["25.5", "Y"] + ["none"] * 6 + ["#"]
    (tmp_path / "s.txt").write_text(",".join(R.MULTISENSOR) + "\n" + ",".join(line) + "\n")
    r = R.read_multisensor(spark, str(tmp_path / "s.txt")).first()
    assert (r["stn_no"], r["dt_utc"], r["p"], r["wg"], r["wg_q"], r["mslp"], r["t"]) == (1234, dt.datetime(2024, 1, 1, 0, 1), 0.2, 25.5, "Y", None, None)


def test_published_rows_are_in_order(spark, tmp_path):
    rows = [(k % 7, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(k * 37) % 400), float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "stn_id long, dt_utc timestamp_ntz, gust double").repartition(5)
    R.publish(df, {"stn_id": "station", "dt_utc": "time", "gust": "wind"}, ["time", "station"], str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*.csv")) for x in f.read_text().splitlines()[1:]]
    keys = [(x.split(",")[1], int(x.split(",")[0])) for x in lines]
    assert len(keys) == 200 and keys == sorted(keys)


def test_one_row_and_zero_top(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    assert [r["ari"] for r in M.adjusted_rand(one, "a", "b").collect()] == [None]
    flat = spark.createDataFrame([(1, 0.0), (0, 0.0), (0, -1.0), (0, 3.0)], "scw int, x double")
    for top in (0.0, None):
        got = {tuple(r[c] for c in ("threshold", "hits", "misses", "false_alarms", "correct_nulls")) for r in K.threshold_sweep(flat, [], "scw", "x", 5, top).collect()}
        assert got == {(0.0, 0, 1, 1, 2)}
    assert K.threshold_sweep(flat.where("scw = 0"), [], "scw", "x", 5).count() == 0


def test_best_threshold_is_the_first(spark):
    rows = [(1, x) for x in (6.0, 7.0, 10.0)] + [(0, x) for x in (1.0, 2.0, 3.0, 6.5)]
    swept = K.scores(K.threshold_sweep(spark.createDataFrame(rows, "scw int, x double"), [], "scw", "x", 11))
    best = {r["score"]: (r["step"], round(r["best"], 6)) for r in K.best_threshold(swept, [], ["tss", "csi"]).collect()}
    assert best == {"tss": (3, 0.75), "csi": (3, 0.75)}


def test_auc_turns_round(spark):
    rows = [(1, float(x)) for x in (1, 2, 3)] + [(0, float(x)) for x in (2, 5, 6)]
    df = spark.createDataFrame(rows, "scw int, x double")
    plain, mean, most = (K.auc(df, [], "scw", "x", orient=o).first()["auc"] for o in (None, "mean", "max"))
    assert math.isclose(plain, 1.5 / 9) and math.isclose(mean, 1 - 1.5 / 9) and mean == most


def test_running_totals_over_ranges(spark):
    from galeworks.operators.ordered import exact_quantiles, running_totals

    r = np.random.default_rng(2)
    rows = [(None if k % 11 == 0 else int(k % 3), float(x), 1) for k, x in enumerate(r.integers(0, 60, 500))]
    df = spark.createDataFrame(rows, "k int, x double, n int")
    got = running_totals(df.groupBy("k", "x").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), ["k"], ["x"], ["n"]).collect()
    for g in got:
        own = [x for k, x, _ in rows if k == g["k"]]
        assert (g["before_n"], g["all_n"], g["n"]) == (sum(x < g["x"] for x in own), len(own), own.count(g["x"]))
    for q in exact_quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 1.0}).collect():
        own = [x for k, x, _ in rows if k == q["k"]]
        assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(own, [0.1, 0.5, 1.0]))
    assert running_totals(df.where("false"), ["k"], ["x"], ["n"]).count() == 0 and exact_quantiles(df.where("false"), [], "x", {"a": 0.5}).count() == 0


def test_events_without_series_stay(spark):
    from galeworks.operators import temporal as T

    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, 7, base), (2, 7, base), (3, 8, base)], "id long, stn long, t timestamp_ntz")
    series = spark.createDataFrame([(7, base + dt.timedelta(minutes=m), v) for m, v in ((-30, 1.0), (0, None), (20, 3.0), (61, 9.0))], "stn long, t timestamp_ntz, v double")
    got = {r["id"]: (r["n"], r["missing"], r["total"], r["mean"]) for r in T.window_sums(events, series, ["stn"], "id", "t", "t", "v", 1800, 3600).collect()}
    assert got == {1: (2, 1, 4.0, 2.0), 2: (2, 1, 4.0, 2.0), 3: (0, 0, None, None)}


def test_leading_mean_needs_its_end(spark):
    from galeworks.operators import temporal as T

    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base + dt.timedelta(minutes=m), float(m)) for m in (0, 60, 120, 150)], "stn long, t timestamp_ntz, v double")
    got = [r["a"] for r in T.rolling_mean(df, ["stn"], "t", "v", 0, 7200, 2, "a", require_end=True).orderBy("t").collect()]
    assert got == [60.0, None, None, None]


def test_nearest_on_axis_ties_and_limits(spark):
    points = spark.createDataFrame([(0, -9.0), (1, 1.0), (2, 2.5), (3, 99.0), (4, None), (5, 7.0)], "p int, v double")
    axis = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (11.0,), (None,)], "a double")
    assert {r["p"]: r["a"] for r in S.nearest_on_axis(points, axis, "v", "a").collect()} == {0: 0.0, 1: 0.0, 2: 2.0, 3: 11.0, 4: None, 5: 3.0}
    assert {r["a"] for r in S.nearest_on_axis(points, axis.where("false"), "v", "a").collect()} == {None}
    assert {r["a"] for r in S.nearest_on_axis(points.where("v is not null"), axis.where("a = 2"), "v", "a").collect()} == {2.0}


def test_nearest_in_box_looks_further(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 80.0, 0.0)], "s int, la double, lo double")
    cells = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 20.0)], "c int, lat double, lon double")
    got = S.nearest_in_box(points, cells, "s", ("la", "lo"), ["c"], 50, (-10, -10, 10, 10)).collect()
    assert sorted((r["s"], r["c"]) for r in got) == [(1, 1), (2, 1)]


def test_radius_summary_refuses_unknown_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "s int, x double")
    for how in ({"x": ["mode"]}, {"y": ["max"]}):
        with pytest.raises(ValueError):
            S.radius_summary(df, ["s"], how)


def test_fallback_station_fills_up(spark):
    from pyspark.sql import functions as F

    from galeworks.operators.events import pick_cases

    rows = [(i, 1 if i < 2 else 2, 100.0 - i, False, False) for i in range(8)] + [(20, 1, 5.0, True, False), (21, 1, 5.0, False, True)]
    df = spark.createDataFrame(rows, "event_id int, loc int, gust double, stormless boolean, radarless boolean")
    got = sorted((r["loc"], r["label"], r["event_id"]) for r in pick_cases(df, "loc", F.col("loc") - 1, [F.desc("gust")], 3).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 3, 20), (1, 4, 21), (1, 5, 2), (2, 1, 2), (2, 1, 3), (2, 1, 4), (2, 2, 5), (2, 2, 6), (2, 2, 7)]


def test_gradient_of_a_plane(spark):
    rows = [(0, i, j, -30.0 + i, 140.0 + j, 2.0 * math.radians(-30.0 + i) * 6373.0) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "h int, i int, j int, lat double, lon double, x double")
    assert all(math.isclose(r["g"], 2.0) for r in G.gradient_magnitude(df, "h", "x", "g").collect())


def test_models(spark):
    r = np.random.default_rng(3)
    rows = [(int(k % 3), float(10 * (k % 3) + r.normal()), float(r.normal()), int(10 * (k % 3) + r.normal() > 5)) for k in range(150)]
    df = spark.createDataFrame(rows + [(0, None, 0.0, 0)], "own int, a double, b double, event int")
    found = df.withColumn("group", M.kmeans_assign(["a", "b"], M.kmeans_fit(df, ["a", "b"], 3)))
    assert M.adjusted_rand(found.where("a is not null"), "own", "group").first()["ari"] > 0.95
    assert [x["group"] for x in found.where("a is null").collect()] == [None]
    terms = M.logit_fit(df, ["a", "b"], "event")
    assert K.auc(df.where("a is not null").withColumn("p", M.score(terms)), [], "event", "p").first()["auc"] > 0.98
    loadings = M.pca(df, ["a", "b"], 2)
    assert math.isclose(sum({x["component"]: x["variance"] for x in loadings.collect()}.values()), 1.0)
    importances, scored = M.balanced_forest(df, ["a", "b"], "event")
    assert importances.orderBy("importance", ascending=False).first()["predictor"] == "a" and scored.count() == 150


def test_stream_and_batch_agree(spark, tmp_path):
    from pyspark.sql import functions as F

    from galeworks.streaming import gusts as T

    events = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = T.gust_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp, value double")
    for name, f in (("peaks", lambda d: T.hourly_peaks(d, ["user_id"], "ts", "value")), ("spells", lambda d: T.severe_spells(d, ["user_id"], "ts", "value", 50.0, "12 hours"))):
        run = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
        got, want = (sorted(map(str, d.collect())) for d in (spark.table(name), f(events)))
        assert got == want and got


def test_stratified_splits_keep_shares(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 5 = 0 as int) as event")
    got = C.stratified_splits(df, "id", "event", 2, 0.25).groupBy("split", "event", "test").count().collect()
    assert len(got) == 8
    for r in got:
        assert abs(r["count"] / (800 if r["event"] else 3200) - (0.25 if r["test"] else 0.75)) < 0.01
    both = C.stratified_splits(df, "id", "event", 2, 0.25).where("test").groupBy("id").count().where("count = 2").count()
    assert 100 < both < 500
    assert C.stratified_splits(df.where("false"), "id", "event", 2, 0.25).count() == 0


def test_backfill_and_motion(spark):
    df = C.backfill_columns(spark.createDataFrame([(1, 2.0)], "uid long, bbox double"), {"bbox": "double", "eccentricity": "double", "num_of_scans": "long"})
    assert [tuple(r) for r in df.collect()] == [(1, 2.0, None, 0)]
    gusts = spark.createDataFrame([("a", 1, 2), ("b", None, 2), ("c", -1, 9), ("d", 7, 2)], "g string, x long, y long")
    tracks = spark.createDataFrame([(1, 5.0, 90.0), (2, 3.0, 90.0), (2, 4.0, 90.0), (-1, 9.0, 90.0)], "uid long, speed double, angle double")
    got = {r["g"]: round(r["u"], 9) for r in C.storm_motion_of_gust(gusts, tracks, [], ["x", "y"]).collect()}
    assert got == {"a": 5.0, "b": 4.0, "d": 4.0}
    assert C.storm_motion_of_gust(gusts.union(gusts), tracks, [], ["x", "y"]).count() == 6


def test_forward_selection_leaves_noise_out(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(k, float(a), float(b), float(c), int(a + b + r.normal() / 3 > 0.3)) for k, (a, b, c) in enumerate(r.normal(size=(600, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, noise double, event int")
    draws = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1000)) < 632)
    assert [x["predictor"] for x in M.forward_selection(df, ["noise", "a", "b"], "event", draws).collect()] in (["a", "b"], ["b", "a"])
    a, noise = M.logit_p_values(df, ["a", "noise"], "event")
    assert a < 1e-6 < 0.01 < noise
