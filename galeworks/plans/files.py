"""Readers and sinks at work on the given tables: rows go out as files of a known form and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeworks.plans.registry import query
from galeworks.plans.views import ctes, view
from galeworks.sources import readers as R


def _csv(df, name):
    path = R.scratch(df.sparkSession, name)
    df.write.csv(path)
    return path


def _gusts(spark, sf_dir):
    return view(spark, sf_dir, "obs").withColumns({"text": F.date_format("dt_utc", "yyyyMMddHHmm"), "hd": F.lit("hd"), "end": F.lit("#")})


@query(ctes("obs") + " SELECT date_trunc('minute', dt_utc)::TIMESTAMP AS dt_utc, stn_id, round(gust, 6) AS gust, q FROM obs")
def read_raw_gusts(spark, sf_dir):
    path = _csv(_gusts(spark, sf_dir).select("hd", "stn_id", F.col("text").alias("lt"), "text", "gust", "q", "end"), "gusts")
    return R.read_raw_gusts(spark, path).select("dt_utc", "stn_id", F.round("gust", 6).alias("gust"), "q")


@query(ctes("obs") + " SELECT date_trunc('minute', dt_utc)::TIMESTAMP AS dt_utc, stn_id, round(gust, 6) AS gust FROM obs WHERE q = 'Y'")
def read_split_gusts(spark, sf_dir):
    part = [F.substring("text", a, n).alias(f"{p}{a}") for p in "lu" for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2))]
    path = _csv(_gusts(spark, sf_dir).select("hd", "stn_id", *part, (F.col("gust") * 3.6).alias("gust"), "q", "end"), "gusts")
    return R.read_raw_gusts(spark, path, layout=2).where("q = 'Y'").select("dt_utc", "stn_id", F.round("gust", 6).alias("gust"))


@query(ctes("stations") + " SELECT stn_no, round(lat, 6) AS lat, round(lon, 6) AS lon, y1::INTEGER AS y1, y2::INTEGER AS y2 FROM stations")
def read_stations(spark, sf_dir):
    s = view(spark, sf_dir, "stations")
    cols = {"stn_no": F.col("stn_no"), "lat": F.col("lat"), "lon": F.col("lon"), "y1": F.col("y1"), "y2": F.col("y2")}
    path = _csv(s.select(*[cols.get(n, F.lit("x")).cast("string").alias(n) for n in R.STATION]), "stations")
    return R.read_stations(spark, path).select("stn_no", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "y1", "y2")


@query(ctes("stations") + " SELECT stn_no, y1::INTEGER AS y1, stn_no % 2 AS layout FROM stations")
def read_fixed_width_sites(spark, sf_dir):
    """Site lists of two layouts as one table."""
    layouts = [{"stn_no": (1, 10), "y1": (12, 4)}, {"y1": (3, 4), "stn_no": (10, 8)}]
    text = [F.concat(F.lpad(F.col("stn_no").cast("string"), 10, " "), F.lit(" "), F.col("y1").cast("string")), F.concat(F.lit("s "), F.col("y1").cast("string"), F.lit("   "), F.rpad(F.col("stn_no").cast("string"), 8, " "))]
    out = None
    for k, (line, places) in enumerate(zip(text, layouts, strict=True)):
        path = R.scratch(spark, "sites")
        view(spark, sf_dir, "stations").where(F.col("stn_no") % 2 == k).select(line).write.text(path)
        part = R.read_fixed_width(spark, path, places).select(F.col("stn_no").cast("long").alias("stn_no"), F.col("y1").cast("int").alias("y1"), F.lit(k).cast("long").alias("layout"))
        out = part if out is None else out.unionByName(part)
    return out


@query(ctes("obs") + " SELECT rid % 5 AS state, year(dt_utc)::INTEGER AS year, stn_id, count(*)::BIGINT AS n, round(sum(gust), 6) AS total FROM obs WHERE year(dt_utc) IN (2023, 2024) GROUP BY ALL")
def restructure_by_year(spark, sf_dir):
    """Files a station group, read as one, go to tables by state and year, clipped to the asked years."""
    raw = R.scratch(spark, "stations")
    gusts = _gusts(spark, sf_dir).withColumn("part", F.col("stn_id") % 16).select("hd", "stn_id", F.col("text").alias("lt"), "text", "gust", "q", "end", "part")
    gusts.write.partitionBy("part").csv(raw)
    path = R.scratch(spark, "by-year")
    read = R.read_raw_gusts(spark, raw).withColumn("state", F.col("stn_id") % 25 % 5)
    R.restructure_by_year(read, path, "state", "dt_utc", [2023, 2024])
    out = spark.read.parquet(path).groupBy(F.col("state").cast("long").alias("state"), "year", "stn_id")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("gust"), 6).alias("total"))


@query(ctes("obs") + " SELECT stn_id AS station, dt_utc AS time_utc, round(gust, 6) AS wind_gust, 1 AS event FROM obs WHERE gust >= 100 UNION ALL SELECT stn_id, dt_utc, round(gust, 6), 0 FROM obs WHERE gust BETWEEN 60 AND 80")
def publish_gusts(spark, sf_dir):
    """Events and non-events under public names, in order of time, as one text table."""
    path = R.scratch(spark, "published")
    obs = view(spark, sf_dir, "obs")
    both = obs.where("gust >= 100").withColumn("scw", F.lit(1)).unionByName(obs.where("gust between 60 and 80").withColumn("scw", F.lit(0)))
    R.publish(both, {"stn_id": "station", "dt_utc": "time_utc", "gust": "wind_gust", "scw": "event"}, ["time_utc", "station"], path)
    read = spark.read.schema("station long, time_utc timestamp_ntz, wind_gust double, event int").option("timestampNTZFormat", R.MICROS).csv(path, header=True)
    return read.withColumn("wind_gust", F.round("wind_gust", 6))


_KINDS = ctes("obs", "tracks") + """, scw_envs AS (SELECT rid, event_id, stn_id % 500 AS uid, gust FROM obs WHERE gust >= 100), null_envs AS (SELECT rid, event_id, stn_id % 500 AS uid, gust FROM obs WHERE gust < 100),
 storms AS (SELECT uid, uid % 25 AS rid, avg(max_alt) AS max_alt, min(time) AS time FROM tracks GROUP BY uid), hit AS (SELECT DISTINCT uid FROM scw_envs)"""


def _kinds(spark, sf_dir):
    """The four tables: severe gusts, the others, storms that brought one, and the other storms."""
    obs = view(spark, sf_dir, "obs").select("rid", "event_id", (F.col("stn_id") % 500).alias("uid"), "gust", "dt_utc")
    storms = view(spark, sf_dir, "tracks").groupBy("uid").agg(F.avg("max_alt").alias("max_alt"), F.min("time").alias("time")).withColumn("rid", F.col("uid") % 25)
    hit = obs.where("gust >= 100").select("uid").distinct()
    return {"scw_envs": obs.where("gust >= 100"), "null_envs": obs.where("gust < 100"), "scw_storms": storms.join(hit, "uid", "left_semi"), "null_storms": storms.join(hit, "uid", "left_anti")}


@query(_KINDS + """ SELECT 'scw_envs' AS name, rid, count(*) AS n, round(sum(gust), 4) AS total FROM scw_envs GROUP BY rid UNION ALL SELECT 'null_envs', rid, count(*), round(sum(gust), 4) FROM null_envs GROUP BY rid
UNION ALL SELECT 'scw_storms', rid, count(*), round(sum(max_alt), 4) FROM storms SEMI JOIN hit USING (uid) GROUP BY rid UNION ALL SELECT 'null_storms', rid, count(*), round(sum(max_alt), 4) FROM storms ANTI JOIN hit USING (uid) GROUP BY rid""")
def write_event_tables(spark, sf_dir):
    path, kinds = R.scratch(spark, "events"), _kinds(spark, sf_dir)
    R.write_event_tables(kinds, path)
    out = None
    for name, df in kinds.items():
        value = "gust" if "gust" in df.columns else "max_alt"
        part = R.read_partitioned(spark, f"{path}/{name}", df.schema).groupBy(F.lit(name).alias("name"), F.col("rid").cast("long").alias("rid")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_KINDS + " SELECT rid, 1 AS scw, event_id, round(gust, 6) AS gust FROM scw_envs UNION ALL SELECT rid, 0, event_id, round(gust, 6) FROM null_envs")
def multi_radar_union(spark, sf_dir):
    """The written event and non-event tables of all radars as one, with rid and scw."""
    path, kinds = R.scratch(spark, "events"), _kinds(spark, sf_dir)
    R.write_event_tables({n: kinds[n] for n in ("scw_envs", "null_envs")}, path)
    both = R.union_radars(spark, path, {"scw_envs": 1, "null_envs": 0}, {n: df.schema for n, df in kinds.items()})
    return both.select(F.col("rid").cast("long").alias("rid"), "scw", "event_id", F.round("gust", 6).alias("gust"))


@query(ctes("obs") + " SELECT rid, year(dt_utc)::INTEGER AS year, month(dt_utc)::INTEGER AS month, count(*) AS n, round(sum(gust), 4) AS total FROM obs WHERE month(dt_utc) <= 2 GROUP BY ALL")
def write_merged(spark, sf_dir):
    """The merged table goes out by radar and month; a reader of two months opens their folders alone."""
    path = R.scratch(spark, "merged")
    R.write_merged(view(spark, sf_dir, "obs"), path, "dt_utc")
    read = spark.read.parquet(path).where("month <= 2").groupBy(F.col("rid").cast("long").alias("rid"), "year", "month")
    return read.agg(F.count("*").alias("n"), F.round(F.sum("gust"), 4).alias("total"))


@query(ctes("obs", "scan_at_station") + " SELECT event_id AS id, stn_id, 'gust' AS kind, gust AS value FROM obs WHERE gust >= 60 UNION ALL SELECT scan, stn_no, 'scan', field_max FROM scan_at_station WHERE in10km = 1")
def union_all(spark, sf_dir):
    """Tables of several kinds stacked by name."""
    gusts = view(spark, sf_dir, "obs").where("gust >= 60").select(F.col("event_id").alias("id"), "stn_id", F.lit("gust").alias("kind"), F.col("gust").alias("value"))
    scans = view(spark, sf_dir, "scan_at_station").where("in10km = 1").select(F.col("field_max").alias("value"), F.lit("scan").alias("kind"), F.col("stn_no").alias("stn_id"), F.col("scan").alias("id"))
    return gusts.unionByName(scans)


@query(ctes("tracks") + " SELECT uid, scan, time::TIMESTAMP AS time, round(max_alt, 6) AS max_alt, round(azi_shear, 6) AS azi_shear, strftime(time, '%Y%m%d%H%M%S') || '/' || uid AS group_id FROM tracks")
def load_tracks(spark, sf_dir):
    path = R.scratch(spark, "tracks")
    tracks = view(spark, sf_dir, "tracks").select("uid", "scan", F.col("time").cast("timestamp_ntz").alias("time"), "max_alt", "azi_shear")
    tracks.write.option("timestampNTZFormat", R.MICROS).csv(path, header=True)
    return R.read_tracks(spark, path, "uid long, scan long, time timestamp_ntz, max_alt double, azi_shear double").select("uid", "scan", "time", F.round("max_alt", 6).alias("max_alt"), F.round("azi_shear", 6).alias("azi_shear"), "group_id")


@query("WITH g AS (SELECT l_partkey % 16 AS i, l_orderkey % 18 AS j, CAST(l_shipdate AS TIMESTAMP) + to_hours(l_linenumber * 3) AS time, avg(l_quantity) AS s06, avg(l_tax) AS lr13 FROM lineitem GROUP BY ALL) SELECT i, j, time, round(s06, 6) AS s06, round(lr13, 6) AS lr13 FROM g WHERE time BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31 23:00:00' AND hour(time) IN (0, 6, 12, 18)")
def load_grid(spark, sf_dir):
    """Two fields, each in its own table, cut to two years and the synoptic hours, and joined by time and place."""
    grid = view(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("i"), (F.col("l_orderkey") % 18).alias("j"), (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("l_linenumber") * 3).cast("int"))).alias("time"))
    paths = {}
    for name, c in (("s06", "l_quantity"), ("lr13", "l_tax")):
        paths[name] = R.scratch(spark, name)
        grid.agg(F.avg(c).alias(name)).write.parquet(paths[name])
    at = lambda *t: F.make_timestamp_ntz(*map(F.lit, (*t, 0, 0)))
    out = R.load_grid(spark, paths, ["i", "j"], "time", at(1995, 1, 1, 0), at(1996, 12, 31, 23), [0, 6, 12, 18])
    return out.select("i", "j", "time", F.round("s06", 6).alias("s06"), F.round("lr13", 6).alias("lr13"))


@query("WITH g AS (SELECT l_partkey % 16 AS i, l_orderkey % 18 AS j, CAST(l_shipdate AS TIMESTAMP) + to_hours(l_linenumber * 3) AS time, avg(l_quantity) AS s06, avg(l_tax) AS lr13, avg(l_discount) AS qmean01, avg(l_extendedprice) AS umean06 FROM lineitem GROUP BY ALL) SELECT i, j, time, round(s06, 6) AS s06, round(lr13, 6) AS lr13, round(qmean01, 6) AS qmean01, round(umean06, 4) AS umean06 FROM g WHERE hour(time) IN (0, 6, 12, 18)")
def load_grid_tables(spark, sf_dir):
    """Four fields, each in its own bucketed table, at the synoptic hours of all years: joined without an exchange."""
    time = (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("l_linenumber") * 3).cast("int"))).alias("time")
    grid = view(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("i"), (F.col("l_orderkey") % 18).alias("j"), time)
    fields = {"s06": "l_quantity", "lr13": "l_tax", "qmean01": "l_discount", "umean06": "l_extendedprice"}
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = R.write_grid_tables({v: grid.agg(F.avg(c).alias(v)) for v, c in fields.items()}, R.scratch(spark, "grid"), ["i", "j"], "time", buckets)
    at = lambda *t: F.make_timestamp_ntz(*map(F.lit, (*t, 0, 0)))
    out = R.load_grid_tables(spark, names, ["i", "j"], "time", at(1900, 1, 1, 0), at(2100, 1, 1, 0), [0, 6, 12, 18])
    return out.select("i", "j", "time", *[F.round(v, 4 if v == "umean06" else 6).alias(v) for v in fields])



@query(ctes("obs", "stations") + " SELECT date_trunc('second', dt_utc)::TIMESTAMP AS time, round(lat, 6) AS lat, round(lon, 6) AS lon FROM obs JOIN stations ON stn_no = stn_id WHERE gust >= 60")
def load_strokes(spark, sf_dir):
    """Strokes of both layouts as one table."""
    at = view(spark, sf_dir, "stations").select(F.col("stn_no").alias("stn_id"), "lat", "lon")
    s = view(spark, sf_dir, "obs").where("gust >= 60").join(at, "stn_id").withColumns({"date": F.date_format("dt_utc", "yyyy-MM-dd"), "clock": F.date_format("dt_utc", "HH:mm:ss")})
    more = lambda n: [F.lit(k).alias(f"x{k}") for k in range(n)]
    six, nine = (_csv(s.where(F.col("event_id") % 2 == k).select("date", "clock", "lat", "lon", *more(n)), "strokes") for k, n in ((0, 2), (1, 5)))
    return R.read_strokes(spark, [six], [nine]).select("time", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(ctes("obs") + " SELECT stn_id AS stn_no, date_trunc('minute', dt_utc)::TIMESTAMP AS dt_utc, round(gust, 6) AS wg, CASE WHEN event_id % 3 <> 0 THEN round(gust / 10, 6) END AS p, 1000.0 + event_id % 30 AS pres, q AS wg_q FROM obs")
def load_multisensor(spark, sf_dir):
    """Files of all sensors; what is no number is null."""
    known = {"hd": F.lit("HD01D"), "stn_no": F.col("stn_id"), "dt_utc": F.col("text"), "dt_lt": F.col("text"), "wg": F.col("gust"), "wg_q": F.col("q"), "p": F.when(F.col("event_id") % 3 != 0, (F.col("gust") / 10).cast("string")).otherwise("###"), "pres": 1000.0 + F.col("event_id") % 30, "end": F.lit("#")}
    path = _csv(_gusts(spark, sf_dir).select(*[known.get(n, F.lit("")).alias(n) for n in R.MULTISENSOR]), "sensors")
    return R.read_multisensor(spark, path, header=False).select("stn_no", "dt_utc", F.round("wg", 6).alias("wg"), F.round("p", 6).alias("p"), "pres", "wg_q")


@query(ctes("obs") + " SELECT DISTINCT date_trunc('hour', dt_utc)::TIMESTAMP AS time FROM obs WHERE date_trunc('hour', dt_utc) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def discover_by_filename(spark, sf_dir):
    """Files named by their hour within a day, by their names alone."""
    path = R.scratch(spark, "scans")
    some = view(spark, sf_dir, "obs").where("dt_utc between timestamp_ntz '2024-01-04' and timestamp_ntz '2024-01-08'")
    some.select("gust", F.date_format("dt_utc", "yyyyMMdd_HH").alias("hour")).repartition("hour").write.partitionBy("hour").parquet(path)
    at = lambda day: F.make_timestamp_ntz(*map(F.lit, (2024, 1, day, 0, 0, 0)))
    return R.discover_by_filename(spark, path, r"hour=(\d{8}_\d{2})/", "yyyyMMdd_HH", at(5), at(6)).select("time").distinct()


@query(ctes("mask") + " SELECT scan, uid, i::BIGINT AS i, j::BIGINT AS j FROM mask")
def mask_to_long(spark, sf_dir):
    at = view(spark, sf_dir, "mask").groupBy("scan", "uid").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), F.max("i").alias("i1"), F.max("j").alias("j1"), F.collect_set(F.struct("i", "j")).alias("on"))
    cells = "transform(sequence(i0, i1), a -> transform(sequence(j0, j1), b -> cast(array_contains(on, named_struct('i', a, 'j', b)) as int)))"
    return R.mask_to_long(at.select("scan", "uid", "i0", "j0", F.expr(cells).alias("cells"))).select("scan", "uid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query("SELECT o_orderkey, make_timestamp(2020, 1, 1, 0, 0, 0.0) + to_hours(o_custkey % 8784) AS time FROM orders WHERE o_custkey % 8784 BETWEEN 240 AND 960")
def load_lightning_grid(spark, sf_dir):
    """Hours counted from new year as times, cut to thirty days."""
    at = view(spark, sf_dir, "orders").select("o_orderkey", R.hour_index(F.lit(2020), (F.col("o_custkey") % 8784).cast("int")).alias("time"))
    return at.where(F.col("time").between(R.hour_index(F.lit(2020), F.lit(240)), R.hour_index(F.lit(2020), F.lit(960))))


@query("WITH c AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.d = CAST(e.ts AS DATE) - 1)")
def coverage_check(spark, sf_dir):
    events = view(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return R.coverage_check(events, events.select("user_id", "ts"), "user_id", "ts", "ts").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def exclude_bad_files(spark, sf_dir):
    bad = view(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.exclude(view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), bad, "o_custkey").select("o_orderkey")
