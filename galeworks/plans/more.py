"""Further joins and expressions over the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeworks.functions import exprs as X
from galeworks.operators import climate as C
from galeworks.operators import resampling as B
from galeworks.operators import skill as K
from galeworks.operators import spatial as P
from galeworks.operators import temporal as T
from galeworks.operators.ordered import exact_quantiles
from galeworks.plans.registry import query
from galeworks.plans.space import _AT, PLACE, hourly, of_stations
from galeworks.plans.views import ctes, rounded, view
from galeworks.streaming import gusts as S

ENV, OBS, SKILL, TRACKS = ctes("env"), ctes("obs"), ctes("skill"), ctes("tracks")


@query(ENV + ", n AS (SELECT e.h, e.i, e.j, f.s06 FROM env e LEFT JOIN env f ON f.i = e.i AND f.j = e.j AND f.h = e.h + 1) SELECT h, i, j, round(last_value(s06 IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY h), 6) AS s06 FROM n")
def shift_hour(spark, sf_dir):
    return rounded(T.shift_hour(view(spark, sf_dir, "env").select("h", "i", "j", "s06"), ["i", "j"], "h", "s06").select("h", "i", "j", "s06"))


@query(ENV + ", t AS (SELECT i, j, unnest(range(max(h) + 1)) AS target FROM env GROUP BY i, j) SELECT t.i, t.j, target::BIGINT AS target, round(s06, 6) AS s06 FROM t JOIN env e ON e.i = t.i AND e.j = t.j AND e.h = (target + 1) // 3 * 3")
def upsample_nearest(spark, sf_dir):
    """Each third hour's field at every hour, by the nearest of these hours."""
    return rounded(T.upsample_nearest(view(spark, sf_dir, "env").select("i", "j", "h", "s06"), ["i", "j"], "h", 3).select("i", "j", "target", "s06"))


@query(OBS + ", s AS (SELECT user_id % 25 AS rid, date_trunc('hour', ts) AS slot, arg_max(value, struct_pack(t := ts, v := value)) AS other FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, round(coalesce(a.other, b.other), 6) AS other FROM obs LEFT JOIN s a ON a.rid = obs.rid AND a.slot = date_trunc('hour', dt_utc) LEFT JOIN s b ON b.rid = obs.rid AND b.slot = date_trunc('hour', dt_utc) - INTERVAL 1 HOUR WHERE a.rid IS NOT NULL OR b.rid IS NOT NULL")
def lookup_with_gap(spark, sf_dir):
    """The value of a gust's own hour, else of the hour before, and of no other."""
    clicks = view(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("user_id") % 25).alias("rid"), F.col("ts").alias("seen"), F.col("value").alias("other"))
    return rounded(T.lookup_with_gap(view(spark, sf_dir, "obs"), clicks, ["rid"], "event_id", "dt_utc", "seen", "other", 3600).select("event_id", "other"))


@query(SKILL + " SELECT row_id, scw = 1 AND floor(l_tax * 100 + 0.5) >= 2 AS two, scw = 1 AND floor(l_tax * 100 + 0.5) >= 1 AS one FROM skill")
def lightning_qualified(spark, sf_dir):
    """Severe rows with two strokes, or one."""
    strokes = F.floor(F.col("l_tax") * 100 + 0.5)
    return view(spark, sf_dir, "skill").select("row_id", *[X.lightning_qualified(F.col("scw"), strokes, n).alias(c) for n, c in ((2, "two"), (1, "one"))])


@query(OBS + " SELECT rid, count(*) AS hours, min(h)::TIMESTAMP AS first_hour FROM (SELECT rid, unnest(generate_series(date_trunc('month', min(dt_utc)), date_trunc('month', max(dt_utc)) + INTERVAL 1 MONTH - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM obs GROUP BY rid) GROUP BY rid")
def hourly_sequence(spark, sf_dir):
    """Every hour of the months that a radar has data in."""
    spans = view(spark, sf_dir, "obs").groupBy("rid").agg(F.date_trunc("month", F.min("dt_utc")).alias("a"), F.date_trunc("month", F.max("dt_utc")).alias("b"))
    hours = spans.select("rid", F.explode(F.expr("sequence(a, b + interval 1 month - interval 1 hour, interval 1 hour)")).alias("h"))
    return hours.groupBy("rid").agg(F.count("*").alias("hours"), F.min("h").cast("timestamp_ntz").alias("first_hour"))


@query(_AT + ", r AS (SELECT *, row_number() OVER (PARTITION BY stn_no, h ORDER BY s06 DESC, i DESC, j DESC) AS n FROM at_hour) SELECT stn_no, h, round(s06, 6) AS s06, round(lr13, 6) AS lr13, round(qmean01, 6) AS qmean01 FROM r WHERE n = 1")
def value_at_argmax(spark, sf_dir):
    turned = hourly(spark, sf_dir).withColumns({"di": -F.col("i"), "dj": -F.col("j")})  # of equals the last cell
    return rounded(of_stations(spark, sf_dir, P.extreme_point(turned, [*PLACE, "h"], F.col("s06"), ["di", "dj"], ["lr13", "qmean01"], name="s06")).select("stn_no", "h", "s06", "lr13", "qmean01"))


@query(SKILL + ", f AS (SELECT cluster, mon, sum(l_tax) AS strokes FROM skill WHERE yr < 1998 GROUP BY ALL) SELECT row_id, round(CASE WHEN yr < 1998 THEN strokes END, 4) AS strokes FROM skill LEFT JOIN f USING (cluster, mon) WHERE yr >= 1998 OR strokes IS NOT NULL")
def attach_lightning(spark, sf_dir):
    """Covered years take the joined value and need one; the others are kept with null."""
    s = view(spark, sf_dir, "skill")
    flashes = s.where("yr < 1998").groupBy("cluster", "mon").agg(F.sum("l_tax").alias("strokes"))
    return rounded(C.attach_covered(s, flashes, ["cluster", "mon"], "strokes", F.col("yr") < 1998).select("row_id", "strokes"), 4)


@query("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, max(value) AS peak, round(avg(value), 6) AS mean, count(value)::BIGINT AS n FROM events GROUP BY ALL")
def hourly_peaks(spark, sf_dir):
    out = S.hourly_peaks(view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "value")
    return rounded(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@query("WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value >= 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM e) SELECT user_id, min(ts)::TIMESTAMP AS first, max(ts)::TIMESTAMP AS last, max(value) AS peak, count(*)::BIGINT AS n FROM g GROUP BY user_id, spell")
def severe_spells(spark, sf_dir):
    out = S.severe_spells(view(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "value", 50.0, "12 hours")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "peak", "n")


@query(SKILL + ", q AS (SELECT quantile_cont(l_quantity, 0.975) AS top FROM skill WHERE scw = 0), t AS (SELECT unnest(range(50)) AS step) SELECT step::INTEGER AS step, count_if(scw = 1 AND l_quantity >= step * top / 49)::BIGINT AS hits, count_if(scw = 0 AND l_quantity >= step * top / 49)::BIGINT AS false_alarms FROM skill, q, t GROUP BY step")
def threshold_sweep_v0(spark, sf_dir):
    """Fifty thresholds up to the 97.5th percentile of the non-events, '>=': rows are binned once, by whole steps."""
    s = view(spark, sf_dir, "skill")
    top = exact_quantiles(s.where("scw = 0"), [], "l_quantity", {"top": 0.975}).first()["top"]
    return K.threshold_sweep(s, [], "scw", "l_quantity", 50, top, at_least=True).select("step", "hits", "false_alarms")


@query(TRACKS + " SELECT uid, scan, round(azi_shear / nullif(speed, 0), 6) AS ratio, strftime(time + INTERVAL 10 HOUR, '%Y-%m-%d %H') AS local_hour, CASE uid % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END::BIGINT AS cluster FROM tracks")
def track_expressions(spark, sf_dir):
    t = view(spark, sf_dir, "tracks")
    local = X.local_time(F.col("time").cast("timestamp"), F.lit("+10:00"))
    return rounded(t.select("uid", "scan", X.ratio(F.col("azi_shear"), F.col("speed")).alias("ratio"), F.date_format(local, "yyyy-MM-dd HH").alias("local_hour"), X.relabel(F.col("uid") % 3, {0: 2, 1: 0, 2: 1}).alias("cluster")))


@query(SKILL + ", n AS (SELECT *, count_if(scw = 1) OVER () AS events, count_if(scw = 0) OVER () AS nulls FROM skill) SELECT scw::INTEGER AS scw, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS total FROM n WHERE scw = 1 OR " + B.sql_hashed("row_id") + f" < least(1.0, 0.5 * events / nulls) * {B.PRIME} GROUP BY scw")
def undersample_nulls(spark, sf_dir):
    """Events, and of the non-events a share that gives half as many, drawn by numbers that follow from the row."""
    drawn = B.undersample(view(spark, sf_dir, "skill"), ["row_id"], "scw", 0.5)
    return rounded(drawn.groupBy(F.col("scw").cast("int").alias("scw")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total")), 4)
