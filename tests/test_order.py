"""Ranges, carried rows, windows by running sums and declustering over blocks, each against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeworks.operators import chains as H
from galeworks.operators import events as E
from galeworks.operators import ordered as O
from galeworks.operators import temporal as T

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=int(seconds))


def naive_group(times, width):
    seeds = []
    for t in sorted(times):
        if not seeds or t >= seeds[-1] + width:
            seeds.append(t)
    return {t: max(s for s in seeds if s <= t) for t in times}


def naive_forward(rows, width):
    """The strongest row within `width` of each survivor in turn; rows are (time, tie, strength)."""
    rows, out, i = sorted(rows), [], 0
    while i < len(rows):
        best = i
        for j in range(i, len(rows)):
            if rows[j][0] >= rows[i][0] + width:
                break
            if rows[j][2] > rows[best][2]:
                best = j
        if best == i:
            out.append(rows[i])
            i = next((j for j in range(i, len(rows)) if rows[j][0] >= rows[i][0] + width), len(rows))
        else:
            i = best
    return out


@pytest.mark.parametrize("block_rows", [10, 40, 100_000])
def test_declustering_over_blocks(spark, block_rows):
    r = np.random.default_rng(block_rows)
    rows = []
    for key, n, span in ((1, 400, 40_000), (2, 300, 4_000_000), (3, 1, 10), (4, 200, 3_000), (5, 500, 500_000)):
        rows += [(key, int(t), i, float(r.integers(20, 30))) for i, t in enumerate(r.integers(0, span, n))]
    rows += [(6, 60 * i, i, 25.0) for i in range(700)] + [(7, 60 * i, i, float(i)) for i in range(300)] + [(1, 5, 0, 22.0), (1, 5, 0, 22.0)]  # without gaps, level and rising; repeated rows
    df = spark.createDataFrame([(k, at(t), i, x) for k, t, i, x in rows], "rid long, t timestamp_ntz, id long, gust double")
    got = sorted((x["rid"], x["t"], x["id"], x["gust"]) for x in E.decluster_forward(df, ["rid"], "t", "gust", "id", 600, block_rows).collect())
    want = sorted((k, at(t), i, x) for k in range(1, 8) for t, i, x in naive_forward([(t, i, x) for q, t, i, x in rows if q == k], 600))
    assert got == want
    grouped = E.decluster_group(df, ["rid"], "t", "gust", "id", 600, block_rows)
    assert grouped.columns == [*df.columns, "seed"] and grouped.count() == len(rows)
    seeds = {k: naive_group({t for q, t, *_ in rows if q == k}, 600) for k in range(1, 8)}
    assert sorted((x["rid"], x["t"], x["seed"]) for x in grouped.collect()) == sorted((k, at(t), at(seeds[k][t])) for k, t, *_ in rows)


def test_declustering_of_little(spark):
    df = spark.createDataFrame([], "rid long, t timestamp_ntz, id long, gust double")
    assert E.decluster_forward(df, ["rid"], "t", "gust", "id").count() == 0 and E.decluster_group(df, ["rid"], "t", "gust", "id").count() == 0
    odd = spark.createDataFrame([(None, at(0), None, 5.0), (None, at(10), 2, None), (1, None, 3, 9.0), (None, at(20), 4, 6.0)], df.schema)
    assert [(x["rid"], x["gust"]) for x in E.decluster_forward(odd, ["rid"], "t", "gust", "id", 60).collect()] == [(None, 6.0)]


def test_strongest_ahead_takes_the_first_of_equals():
    times, x = np.array([0, 1, 2, 3, 9]), np.array([5.0, 7.0, 7.0, np.nan, 1.0])
    ahead, stays = H.strongest_ahead(times, x, 4)
    assert ahead.tolist() == [1, 4, 4, 4, 5] and stays.tolist() == [False, True, True, True, True]


@pytest.fixture(scope="module")
def series():
    """One key with most of the rows, some with few; nulls in values, times and keys; equal times."""
    r = np.random.default_rng(12)
    rows = [(1, int(t), None if r.random() < 0.3 else float(r.integers(0, 50)), i) for i, t in enumerate(r.integers(0, 20_000, 600))]
    rows += [(int(k), int(t), float(k), 1000 + i) for i, (k, t) in enumerate(zip(r.integers(2, 5, 60), r.integers(0, 20_000, 60), strict=True))]
    return rows + [(None, 5, 1.0, 2000), (1, None, 2.0, 2001)]


def frame(spark, rows):
    return spark.createDataFrame([(k, None if t is None else at(t), v, i) for k, t, v, i in rows], "k long, t timestamp_ntz, v double, id long")


def test_ranges_hold_one_key_in_parts(spark, series):
    df = O.with_ranges(frame(spark, series), "t")
    parts = df.where("k = 1").groupBy(O.RANGE).count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 250
    assert df.groupBy("t").agg(F.count_distinct(O.RANGE).alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        O.with_ranges(spark.createDataFrame([("a",)], "s string"), "s")
    plan = O.running_totals(df.drop(O.RANGE), ["k"], ["t", "id"], ["id"])._jdf.queryExecution().toString()
    assert "FileScan" not in plan and "RepartitionByExpression" not in plan


@pytest.mark.parametrize("turned", [False, True])
def test_running_totals_of_a_dense_key(spark, series, turned):
    df = frame(spark, series).withColumn("one", F.lit(1))
    got = {r["id"]: (r["before_one"], r["all_one"]) for r in O.running_totals(df, ["k"], ["t", "id"], ["one"], turned=turned).collect()}
    for k, t, _, i in series:
        own = [(-1 if u is None else u, j) for q, u, _, j in series if q == k]
        mine = (-1 if t is None else t, i)
        assert got[i] == (sum(x > mine if turned else x < mine for x in own), len(own))


def test_carried_rows_of_a_dense_key(spark, series):
    df = O.carried(frame(spark, series), ["k"], ["t", "id"], {"a": F.col("v")}, {"b": F.struct("v", "id"), "c": F.when(F.col("v").isNotNull(), F.col("id"))})
    assert O.RANGE not in df.columns
    for r in df.collect():
        own = sorted(((-1 if t is None else t), i, v) for k, t, v, i in series if k == r["k"])
        mine = next(n for n, x in enumerate(own) if x[1] == r["id"])
        assert r["a"] == next((v for _, _, v in reversed(own[: mine + 1]) if v is not None), None)
        assert r["c"] == next((i for _, i, v in own[mine:] if v is not None), None) and r["b"]["id"] == r["id"]


def test_asof_and_nearest_of_a_dense_key(spark, series):
    r = np.random.default_rng(13)
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(r.choice([1, 1, 1, 2, 9], 150), r.integers(0, 15_000, 150), strict=True))]
    left = frame(spark, [x for x in series if x[1] is not None])
    rows = spark.createDataFrame([(k, at(t), i) for k, t, i in right], "k long, s timestamp_ntz, scan long")
    for clip in (False, True):
        got = {x["id"]: x["s"] for x in T.asof_join(left, rows, ["k"], "t", "s", ["scan"], 300, clip).collect()}
        want = {}
        for k, t, _, i in series:
            own = [u for q, u, _ in right if q == k and k is not None and t is not None]
            before = [u for u in own if u <= t]
            if before and t - max(before) <= 300 and (not clip or t <= max(own)):
                want[i] = at(max(before))
        assert got == want and len(want) > 100
    got = {x["id"]: x["s"] for x in T.nearest_time(left, rows, ["k"], "t", "s", "scan", 100).collect()}
    want = {}
    for k, t, _, i in series:
        own = [(abs(u - t), u) for q, u, _ in right if q == k and t is not None]
        if own and min(own)[0] <= 100:
            want[i] = at(min(own)[1])
    assert got == want


def test_fills_of_a_dense_key(spark, series):
    rows = [x for x in series if x[0] == 1 and x[1] is not None]
    seen, once = set(), []
    for x in sorted(rows, key=lambda x: x[1]):
        if x[1] not in seen:
            seen.add(x[1])
            once.append(x)
    got = {r["id"]: r["v"] for r in T.interpolate_linear(frame(spark, once), ["k"], "t", "v").collect()}
    known = [n for n, x in enumerate(once) if x[2] is not None]
    for n, (_, _, v, i) in enumerate(once):
        a, b = max((m for m in known if m <= n), default=None), min((m for m in known if m >= n), default=None)
        if v is not None or b is None:
            assert got[i] == (v if v is not None else once[a][2])
        elif a is None:
            assert got[i] is None
        else:
            assert math.isclose(got[i], once[a][2] + (once[b][2] - once[a][2]) * (n - a) / (b - a))
    total, n, run = 0.0, 0, {r["id"]: r["x"] for r in T.running_total(frame(spark, once), ["k"], ["t"], "v", "x").collect()}
    for _, _, v, i in once:
        total, n = total + (v or 0.0), n + (v is not None)
        assert run[i] == (total if n else None)
    hourly = {r["slot"]: r["v"] for r in T.regular_fill(frame(spark, [(1, 0, 1.0, 0), (1, 3600 * 2, None, 1), (1, 3600 * 7, 5.0, 2)]), ["k"], "t", "v", "1 hour", "hour", 3).collect()}
    assert [hourly[at(3600 * h)] for h in range(8)] == [1.0, 1.0, 1.0, 1.0, None, None, None, 5.0]


def test_windows_by_running_sums(spark, series):
    r = np.random.default_rng(14)
    events = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(r.choice([1, 1, 2, 8], 60), r.integers(-500, 21_000, 60), strict=True))] + [(100, 1, None), (101, None, 10)]
    rows = [*series, (2, 300, float("nan"), 3000), (2, 9000, float("inf"), 3001)]
    windows = {"a": (0, 600), "b": (1800, 0), "c": (7200, 7200), "d": (0.5, 0.5)}
    e = spark.createDataFrame([(i, k, None if t is None else at(t)) for i, k, t in events], "id long, k long, u timestamp_ntz")
    found = T.windows_sums(e, frame(spark, rows), ["k"], "id", "u", "t", "v", windows)
    got = {x["id"]: x for x in found.collect()}
    assert len(got) == len(events)
    for i, k, t in events:
        for name, (before, after) in windows.items():
            own = [v for q, s, v, _ in rows if q == k and None not in (k, s, t) and t - before <= s <= t + after]
            real = [v for v in own if v is not None]
            assert (got[i][f"n_{name}"], got[i][f"missing_{name}"]) == (len(real), len(own) - len(real))
            total = got[i][f"total_{name}"]
            if not real:
                assert total is None and got[i][f"mean_{name}"] is None
            elif not np.isfinite(real).all():
                assert math.isnan(total)
            else:
                assert math.isclose(total, sum(real), abs_tol=1e-12) and math.isclose(got[i][f"mean_{name}"], sum(real) / len(real))
