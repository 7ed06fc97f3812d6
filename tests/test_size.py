"""What showed on tables of 6 GB: batches sent to Python, rows met by cells and places, jobs that were cut short."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from galeworks import catalog
from galeworks.operators import models as M
from galeworks.operators import spatial as S
from galeworks.operators import stormchain as H
from galeworks.operators.ordered import carried


def test_scans_send_kept_rows_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(M, "SENT", 1, raising=False)
    before, batches = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), spark.sparkContext.accumulator(0)
    data = M._held(spark.range(80_000).selectExpr("double(id) AS x"))
    frame, real = type(data), type(data).mapInArrow

    def counted(self, func, schema):
        def own(rows):
            def each():
                for batch in rows:
                    batches.add(1)
                    yield batch

            return func(each())

        return real(self, own, schema)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    kept = data.count()
    assert M.summed(data, lambda x: [np.array([[x.sum(), len(x)]])])[0].tolist() == [[80_000 * 79_999 / 2, 80_000]]
    data.unpersist()
    assert batches.value == kept > 4  # a matrix at a time, not all of a partition
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_what_lies_ahead_is_carried_without_frames_to_the_end(spark):
    rows = [(k, t, x) for k in (1, None) for t, x in enumerate((None, 4.0, None, None, 7.0, None))]
    found = carried(spark.createDataFrame(rows, "k long, t long, x double"), ["k"], ["t"], {"last": F.col("x")}, {"next": F.col("x")}, final={"end": F.col("x")})
    want = [(None, 4.0), (4.0, 4.0), (4.0, 7.0), (4.0, 7.0), (7.0, 7.0), (7.0, None)]
    assert sorted(map(tuple, found.select("k", "t", "last", "next", "end").collect()), key=repr) == sorted(((k, t, *w, 7.0) for k in (1, None) for t, w in enumerate(want)), key=repr)
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().optimizedPlan().toString()  # read anew for each row: quadratic


def test_stations_of_one_place_ask_for_its_storms_once(spark, monkeypatch):
    counts, real = [], H.storm_within_asked
    monkeypatch.setattr(H, "storm_within_asked", lambda masks, asked, *more: counts.append(asked.count()) or real(masks, asked, *more))
    at = lambda h: dt.datetime(2024, 1, 1, h)
    storms = spark.createDataFrame([(1, s, at(s), u, float(u)) for s in range(20) for u in (1, 2)], "rid long, scan long, scan_time timestamp_ntz, uid long, field_max double")
    masks = spark.createDataFrame([(1, s, u, 10 * u, 0) for s in range(20) for u in (1, 2)], "rid long, scan long, uid long, i long, j long")
    points = spark.createDataFrame([*[(1, n, 10, 3) for n in range(9)], (1, 9, 90, 0), (1, 9, 10, 4), (1, 8, None, 3)], "rid long, stn_id long, pi long, pj long")
    gusts = spark.createDataFrame([(n, n, at(4), 30.0 + n, "Y") for n in range(10)] + [(10, 0, at(19), 9.0, "Y"), (11, 0, at(19) + dt.timedelta(seconds=1), 9.0, "Y")], "event_id long, stn_id long, dt_utc timestamp_ntz, gust double, q string")
    found = {r["event_id"]: (r["scan"], r["uid5"], r["in5"], r["dist5"]) for r in H.storms_of_gusts(masks, storms, points, gusts, H.ChainRules(radii=(5,), near=5)).collect()}
    assert found == {**{n: (4, 1, 1, 3.0) for n in range(9)}, 9: (4, 1, 1, 4.0), 10: (19, 1, 1, 3.0)}  # the last gust is after the radar's last scan
    assert counts == [1 + 2 + 2 + 1]


def test_every_storm_has_its_distance_to_every_station(spark):
    storms, stations = {1: [(0.0, 0.0), (0.0, 0.05)], 2: [(0.0, 0.0), (0.0, 0.05)], 3: [(-40.0, 140.0)]}, {5: (0.0, 0.1), 6: (60.0, -170.0), 7: (0.0, 0.1)}
    cells = spark.createDataFrame([(s, 0, *c) for s, own in storms.items() for c in own] + [(1, 0, None, 1.0), (4, 0, None, 2.0)], "scan long, uid long, lat double, lon double")
    points = spark.createDataFrame([(n, *at) for n, at in stations.items()] + [(8, None, 1.0)], "stn long, lat double, lon double")
    found = S.storm_distance(cells, points, ["scan", "uid"], "stn").collect()
    unit = lambda la, lo: np.array([np.cos(np.radians(la)) * np.cos(np.radians(lo)), np.cos(np.radians(la)) * np.sin(np.radians(lo)), np.sin(np.radians(la))])
    far = lambda a, b: 6373.0 * 2 * np.arcsin(np.linalg.norm(unit(*a) - unit(*b)) / 2)
    assert {(r["scan"], r["stn"]) for r in found} == {(s, n) for s in storms for n in stations} and len(found) == 9
    assert all(abs(r["distance"] - min(far(c, stations[r["stn"]]) for c in storms[r["scan"]])) < 0.0006 for r in found)
    assert catalog.queries()["storm_distance"](spark, "/root/testdata/sf0.001").count() == 1500 * 150


def test_rows_are_looked_at_for_runs_that_part_them_alone(spark, monkeypatch):
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(6000, 2)), 1)
    x[:, 1] = np.where(draw.random(6000) < 0.5, 3.0, x[:, 1])
    monkeypatch.setattr(M, "CELL_ROWS", 40)
    data = M._in_cells(spark.createDataFrame([tuple(map(float, v)) for v in np.concatenate([x, x])], "a double, b double"), ["a", "b"])
    parts = [np.frombuffer(r["rows"]).reshape(-1, r["width"]) for r in data.collect()]
    data.unpersist()
    kept, many = np.concatenate(parts), np.unique(np.concatenate([x, x]), axis=0, return_counts=True)
    order = np.lexsort((kept[:, 2], kept[:, 1]))
    assert len(parts) > 10 and (kept[order, 1:] == many[0]).all() and (kept[order, 0] == many[1]).all()  # equal rows once, with their number
    centres = [draw.normal(size=(2 + k % 3, 2)) for k in range(12)]
    looked, real = [], M._nearest
    monkeypatch.setattr(M, "_nearest", lambda rows, every, runs: looked.append(len(rows) * runs) or real(rows, every, runs))
    sums = [M._clusters(m, np.column_stack([np.ones(len(m)), m[:, 1:]]), M._filled(centres)) for m in parts]
    totals, far = sum(s[0] for s in sums), sum(s[1] for s in sums)
    for k, own in enumerate(centres):
        d = ((np.concatenate([x, x])[:, None] - own) ** 2).sum(2)
        near = d.argmin(1)
        assert np.allclose(totals[k, : len(own), 0], np.bincount(near, minlength=len(own))) and np.isclose(far[k, 0], d.min(1).sum())
        assert np.allclose(totals[k, : len(own), 1:], [np.concatenate([x, x])[near == c].sum(0) for c in range(len(own))]) and not totals[k, len(own) :].any()
    assert sum(looked) < 0.7 * len(kept) * len(centres)


def test_gusts_are_filled_by_the_minute(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 1, 0, m, 30), 7, "view", x) for n, (m, x) in enumerate(((0, 1.0), (30, 2.0), (34, 3.0)))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["resample_ffill"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(7, 35, 11 + 4 + 1, 11 * 1.0 + 4 * 2.0 + 3.0)]
