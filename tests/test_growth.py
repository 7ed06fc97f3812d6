"""Work that must follow from different places, shapes and asked scans, not from their copies; tables without rows; means joined on."""

import datetime as dt
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeworks import catalog
from galeworks.operators import grid as G
from galeworks.operators import models as M
from galeworks.operators import spatial as S
from galeworks.operators import stormchain as H
from galeworks.sources import readers as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The smallest tables with every station once more at its own place."""
    path = tmp_path_factory.mktemp("twice")
    for name in os.listdir(SF):
        if name != "customer.parquet":
            (path / name).symlink_to(f"{SF}/{name}")
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    customers.unionByName(customers.withColumn("c_custkey", F.col("c_custkey") + 68_000 * 19)).write.parquet(str(path / "customer.parquet"))
    return str(path), customers.count()


def seen(monkeypatch, name, argument=0):
    """Row counts of an argument of a function of `spatial`, call by call."""
    counts, real = [], getattr(S, name)

    def spy(*args, **more):
        counts.append(args[argument].count())
        return real(*args, **more)

    monkeypatch.setattr(S, name, spy)
    return counts


def test_storm_distance_by_shape_and_place(spark, monkeypatch):
    counts, stations = seen(monkeypatch, "radius_join"), spark.createDataFrame([(n, 0.0, 0.1 * (n % 2)) for n in range(40)], "stn long, lat double, lon double")
    cells = spark.createDataFrame([(s, 7, 0.0, x) for s in range(30) for x in (0.0, 0.05)] + [(99, 7, 0.0, 0.05), (99, 7, None, 1.0)], "scan long, uid long, lat double, lon double")
    got = {(r["scan"], r["stn"]): r["distance"] for r in S.storm_distance(cells, stations, ["scan", "uid"], "stn", 9.0).collect()}
    half = round(6373.0 * 0.05 * 3.141592653589793 / 180, 3)
    assert got == {(s, n): (half if s == 99 or n % 2 else 0.0) for s in [*range(30), 99] for n in range(40)}
    assert counts == [2]


@pytest.mark.parametrize(("query", "function", "argument"), [("storm_within", "storm_within", 1), *[(q, "radius_join", 0) for q in ("strokes_near_station", "value_at_argmax", "radius_summary", "radius_extreme", "lightning_sum", "extreme_point", "attach_hourly_env", "radius_join", "nearest_land_cell")]])
def test_stations_of_one_place_share_its_surroundings(spark, monkeypatch, twice, query, function, argument):
    path, stations = twice
    one = catalog.queries()[query](spark, SF).count()
    counts = seen(monkeypatch, function, argument)
    found = catalog.queries()[query](spark, path)
    rows = found.count()
    assert 0 < max(counts) <= stations
    assert rows == (one if query == "attach_hourly_env" else 2 * one) > 0


def test_gusts_ask_for_storms_of_their_own_scan_alone(spark, monkeypatch):
    counts = seen(monkeypatch, "mask_runs")
    at = lambda h: dt.datetime(2024, 1, 1, h)
    storms = spark.createDataFrame([(1, s, at(s), u, float(u)) for s in range(20) for u in (1, 2)], "rid long, scan long, scan_time timestamp_ntz, uid long, field_max double")
    masks = spark.createDataFrame([(1, s, u, 10 * u, 0) for s in range(20) for u in (1, 2)], "rid long, scan long, uid long, i long, j long")
    points = spark.createDataFrame([(1, 5, 10, 3), (1, 6, 90, 0)], "rid long, stn_id long, pi long, pj long")
    gusts = spark.createDataFrame([(0, 5, at(4), 30.0, "Y"), (1, 6, at(4), 31.0, "Y"), (2, 5, at(9), 9.0, "N")], "event_id long, stn_id long, dt_utc timestamp_ntz, gust double, q string")
    got = {r["event_id"]: (r["scan"], r["uid5"], r["in5"], r["dist5"]) for r in H.storms_of_gusts(masks, storms, points, gusts, H.ChainRules(radii=(5,), near=5)).collect()}
    assert got == {0: (4, 1, 1, 3.0), 1: (4, 2, 0, None)}
    assert counts == [2]


def test_written_tables_may_be_without_rows(spark, tmp_path):
    some, path = spark.createDataFrame([(1, 2, 5.0)], "rid long, event_id long, gust double"), str(tmp_path / "events")
    tables = {"scw_envs": some, "null_envs": some.where("gust < 0")}
    R.write_event_tables(tables, path)
    assert R.read_partitioned(spark, f"{path}/null_envs", some.schema).collect() == []
    assert [tuple(r) for r in R.union_radars(spark, path, {"scw_envs": 1, "null_envs": 0}, {n: t.schema for n, t in tables.items()}).select("rid", "event_id", "gust", "scw").collect()] == [(1, 2, 5.0, 1)]


def test_means_that_are_joined_on_do_not_follow_the_order(spark):
    means = {spark.createDataFrame([(x,) for x in own], "x double").coalesce(1).agg(G.exact_mean("x").alias("m")).first()["m"] for own in itertools.permutations((0.1, 0.2, 0.3, 1000.7))}
    assert len(means) == 1 and abs(means.pop() - 250.325) < 1e-12
    assert spark.createDataFrame([(None,)], "x double").agg(G.exact_mean("x").alias("m")).first()["m"] is None


def test_profiles_list_each_target_once_without_an_aggregate(spark):
    rows = [(1, 100.0, 1.0), (1, 200.0, 3.0), (1, 200.0, 5.0), (1, 300.0, None), (2, None, 9.0), (2, 50.0, 2.0), (3, None, 4.0)]
    found = G.interp_profile(spark.createDataFrame(rows, "k long, z double, v double"), ["k"], "z", ["v"], [50, 150, 250, 300, 400, 150])
    got = {(r["k"], r["target"]): r["v"] for r in found.collect()}
    assert found.count() == len(got) == 15 and {k: v for k, v in got.items() if v is not None} == {(1, 150.0): 2.0, (2, 50.0): 2.0}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_centres_of_many_runs(spark):
    x = np.random.default_rng(1).normal(size=(500, 3))
    centres = [np.random.default_rng(k).normal(size=(2 + k % 3, 3)) for k in range(9)]
    centres[4][1] = centres[4][0]  # equal distances: the first counts
    for runs, every in M._groups(centres):
        own, d = M._nearest(x, every, len(runs))
        for r, mine, least in zip(runs, own, d, strict=True):
            far = ((x[:, None] - centres[r]) ** 2).sum(2)
            assert (mine.argmax(0) == far.argmin(1)).all() and (mine.sum(0) == 1).all() and np.allclose(least, far.min(1))
