"""What showed on larger tables: means of zero, draws, ranks and fits by values that meet first, grids without a spine."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from galeworks import catalog
from galeworks.operators import cases as C
from galeworks.operators import models as M
from galeworks.operators import resampling as B
from galeworks.operators import skill as K
from galeworks.operators import spatial as S
from galeworks.operators import temporal as T

BASE = dt.datetime(2024, 1, 1)


def test_a_mean_of_zero_is_no_error(spark, tmp_path):
    hours = lambda h: BASE + dt.timedelta(hours=h)
    gusts = [(4, 0, 150.0), (5, 2, 0.0), (13, 40, 0.0), (17, 41, 0.0), (21, 42, 0.0), (25, 300, 30.0), (29, 301, 120.0)]
    rows = [(i, hours(h), 7, "view", x) for i, h, x in gusts]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = {r["event_id"]: r for r in catalog.queries()["event_window_ratios"](spark, str(tmp_path)).collect()}
    assert found[4]["narrow_ratio"] == found[4]["around_ratio"] == math.inf and found[29]["narrow_ratio"] == 1.6
    ahead = {r["event_id"]: r for r in catalog.queries()["gust_ratios"](spark, str(tmp_path)).collect()}
    assert math.isnan(ahead[13]["wgr_2a"])


def test_window_sums_keep_more_than_six_places(spark):
    rows = [(7, BASE + dt.timedelta(seconds=k), x) for k, x in enumerate((0.00000012, 0.00000034))]
    series = spark.createDataFrame(rows, "k long, t timestamp_ntz, x double")
    events = series.select("k", "t").limit(1).withColumn("n", F.lit(1))
    assert T.window_sums(events, series, ["k"], "n", "t", "t", "x", 0, 5).first()["total"] == 0.00000046


def test_drawn_rows_are_as_drawn_counts_of_one_and_compiled(spark):
    rows = spark.range(3000).select(F.col("id").alias("n")).union(spark.createDataFrame([(None,)], "n long"))
    own = B.bootstrap_rows(rows, "n", 20)
    want = B.drawn_counts(rows.withColumn("__one", F.lit(1)), {"weight": ("__one", 1.0)}, ["n"], 20).drop("__one")
    assert own.dtypes == want.dtypes and sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and len(plan) < 20_000  # rounds are written once each


def test_bands_of_ranks_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "RANKS", 8)
    draw = np.random.default_rng(5)
    rows = [(k, r, float(draw.integers(9)), int(draw.integers(1, 6))) for k in (1, None) for r in range(4) for _ in range(3 + 4 * r)]
    drawn = spark.createDataFrame([*rows, (1, 0, None, 3)], "k long, replicate int, v double, weight long")
    lists = {}
    for k, r, v, w in rows:
        lists.setdefault((k, r), []).extend([v] * w)
    ranked = {key: sorted(v, reverse=True) for key, v in lists.items()}
    want = {(k, n + 1): np.quantile([v[n] for (own, _), v in ranked.items() if own == k and len(v) > n], [0.05, 0.95]) for k in (1, None) for n in range(max(len(v) for (own, _), v in ranked.items() if own == k))}
    found = C.rank_bootstrap_band(drawn, ["k"], "v")
    got = {(r["k"], r["rank"]): (r["low"], r["high"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[key], want[key]) for key in want)
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no aggregate over replicates times ranks


def test_areas_carry_totals_of_ranges_alone(spark):
    draw = np.random.default_rng(3)
    rows = [(int(draw.integers(2)), int(draw.integers(2)), f"c{draw.integers(2)}", float(draw.integers(40))) for _ in range(600)]
    df = spark.createDataFrame([*rows, (1, 0, None, 7.0), (1, 1, "c0", None)], "e int, near int, c string, x double")
    found = K.auc_many(df, ["x"], "e", [F.lit("all"), F.col("c")], {"all": F.lit(True), "near": F.col("near") == 1}, None)
    got = {(r["stratum"], r["null_set"]): r["auc"] for r in found.collect()}
    assert len(got) == 6
    for stratum, null_set in got:
        own = [r for r in [*rows, (1, 0, None, 7.0)] if stratum in ("all", r[2])]
        events, nulls = [r[3] for r in own if r[0] == 1], [r[3] for r in own if r[0] == 0 and (null_set == "all" or r[1] == 1)]
        assert abs(got[stratum, null_set] - sum((a > b) + (a == b) / 2 for a in events for b in nulls) / len(events) / len(nulls)) < 1e-12
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_arises_after_the_shuffles(spark):
    hour = lambda h: BASE + dt.timedelta(hours=h)
    rows = [(k, hour(h), x) for k in (1, 2, None) for h, x in ((0, 1.0), (2, None), (9, 5.0), (9.5, 6.0), (10, None))] + [(3, None, 1.0)]
    found = T.regular_fill(spark.createDataFrame(rows, "k long, t timestamp_ntz, v double"), ["k"], "t", "v", "1 hour", "hour", 3)
    own = [1.0] * 4 + [None] * 5 + [6.0] * 2
    assert sorted(map(tuple, found.select("k", "slot", "v").collect()), key=repr) == sorted(((k, hour(h), x if k else None) for k in (1, 2, None) for h, x in enumerate(own)), key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # nothing is joined or ordered after the steps are made
    two = T.regular_fill(spark.createDataFrame(rows[:5], "k long, t timestamp_ntz, v double"), ["k"], "t", "v", "2 hours", "hour", 1)
    assert [r["v"] for r in two.orderBy("slot").collect()] == [1.0, 1.0, None, None, None, None]


def test_draws_are_compiled_and_the_same(spark):
    df = spark.createDataFrame([(i, int(i < 20)) for i in range(220)], "id long, e int")
    drawn = B.resample_events(df, ["id"], "e", 3, 20)
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    turns = [(1, r, t, 20) for r in range(3) for t in range(20)] + [(0, r, t, 200) for r in range(3) for t in range(220)]
    asked = spark.createDataFrame(turns, "side int, replicate int, turn int, have int").select("replicate", (F.expr(B.hashed("side", "replicate", "turn")) % F.col("have") + F.when(F.col("side") == 1, 0).otherwise(20)).alias("id"))
    assert sorted(map(tuple, drawn.select("replicate", "id").collect())) == sorted(map(tuple, asked.collect()))


def test_pairs_of_places_and_cells_are_dealt_out(spark, monkeypatch):
    parts, real = [], S.radius_extremes

    def spy(pairs, *args, **more):
        parts.append(pairs.rdd.getNumPartitions())
        return real(pairs, *args, **more)

    monkeypatch.setattr(S, "radius_extremes", spy)
    catalog.queries()["radius_extreme"](spark, "/root/testdata/sf0.001")
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_splits_are_marked_in_one_shuffle_and_fitted_together(spark, monkeypatch):
    r = np.random.default_rng(11)
    x = r.normal(size=(1500, 2))
    y = r.random(1500) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] - 1)))
    df = spark.createDataFrame([(i, *map(float, v), int(e)) for i, (v, e) in enumerate(zip(x, y, strict=True))] + [(2000, None, 0.0, 1)], "id long, a double, b double, e int")
    marked = C.split_marks(df, "id", "e", 3, 0.25)
    strata = Window.partitionBy("split", "e", "b3")
    spread = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("b3", F.pmod(F.xxhash64("id"), F.lit(3)))
    one = spread.withColumn("test", F.row_number().over(strata.orderBy(C._draw("id", F.col("split"), 17), "id")) <= F.round(0.25 * F.count("*").over(strata)))
    want = sorted(map(tuple, one.select("id", "split", "test").collect()))
    assert want == sorted(map(tuple, C.stratified_splits(df, "id", "e", 3, 0.25).select("id", "split", "test").collect()))
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for k, terms in enumerate(M.logit_splits(marked, ["a", "b"], "e", 3)):
        alone = M.logit_fit(marked.where(~F.get("tests", F.lit(k))), ["a", "b"], "e")
        assert all(math.isclose(terms[n], alone[n], rel_tol=1e-9) for n in alone)
    scans, real = [], M.summed
    monkeypatch.setattr(M, "summed", lambda *args: scans.append(1) or real(*args))
    assert catalog.queries()["stratified_split_cv"](spark, "/root/testdata/sf0.001").count() == 3 and len(scans) <= 5


def test_forward_selection_keeps_its_rows_once(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 3))
    y = r.random(500) < 1 / (1 + np.exp(-(x @ [3.0, 0.0, 1.5])))
    df = spark.createDataFrame([(i, *map(float, v), int(e)) for i, (v, e) in enumerate(zip(x, y, strict=True))] + [(600, None, 0.0, 1.0, 1)], "id long, a double, b double, c double, e int")
    kept, real = [], M._held
    monkeypatch.setattr(M, "_held", lambda d: kept.append(1) or real(d))
    draws = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(10)) < 6)
    first = M.forward_selection(df, ["a", "b", "c"], "e", draws).orderBy("step").first()
    assert len(kept) == 1 and first["predictor"] == "a"
    terms = M._terms(["a"], M.logit_many(M.balanced(df, "e").where("a is not null"), [["a"]], "e", "weight")[0][0])
    swept = K.scores(K.threshold_sweep(df.withColumn("p", M.score(terms)), [], "e", "p", 100, 1.0))
    assert math.isclose(first["hss"], swept.agg(F.max("hss")).first()[0], rel_tol=1e-9)


def test_a_sweep_reads_its_rows_once(spark):
    df = spark.createDataFrame([(k, e, x) for k in (1, None) for e, x in ((1, 0.35), (0, 0.35), (1, 0.9), (0, -1.0), (1, None), (None, 0.5))], "k int, e int, x double")
    found = K.threshold_sweep(df, ["k"], "e", "x", 11, 1.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["k"], r["step"]): (r["hits"], r["misses"], r["false_alarms"], r["correct_nulls"]) for r in found.collect()}
    assert got == {(k, s): (2, 1, 1, 1) if s < 4 else (1, 2, 0, 2) if s < 9 else (0, 3, 0, 2) for k in (1, None) for s in range(11)}
