"""Gusts in time: peak-to-mean ratios, severe events, declustering, as-of joins, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeworks.functions import exprs as X
from galeworks.operators import climate as C
from galeworks.operators import events as E
from galeworks.operators import skill as K
from galeworks.operators import temporal as T
from galeworks.operators.resampling import bootstrap_rows, sql_drawn
from galeworks.plans.registry import query
from galeworks.plans.views import ctes, rounded, view

DAY = 86_400
#: Time scale of the given tables: a row every half day or so, hence days where one-minute data would have hours.
AROUND, LEAST = 2 * DAY, 3
STRONG = 100.0

_RANGE = "PARTITION BY stn_id ORDER BY dt_utc RANGE BETWEEN"
_RATIOS = ctes("obs", recursive=True) + f""", good AS (SELECT * FROM obs WHERE q = 'Y'), m AS (SELECT *,
 CASE WHEN count(gust) OVER w4 >= 3 THEN avg(gust) OVER w4 END AS rolling4, CASE WHEN count(gust) OVER wb >= 3 THEN avg(gust) OVER wb END AS rolling2b,
 CASE WHEN count(gust) OVER wa >= 3 THEN avg(gust) OVER wa END AS rolling2a FROM good WHERE gust IS NOT NULL
 WINDOW w4 AS ({_RANGE} INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY FOLLOWING), wb AS ({_RANGE} INTERVAL 2 DAY PRECEDING AND CURRENT ROW), wa AS ({_RANGE} CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)),
 scw AS (SELECT * FROM m WHERE gust >= 100 AND gust / rolling4 >= 2)"""


def ratios(spark, sf_dir) -> DataFrame:
    good = view(spark, sf_dir, "obs").where("q = 'Y'")
    out = T.rolling_mean(good, ["stn_id"], "dt_utc", "gust", AROUND, AROUND, LEAST, "rolling4")
    out = T.rolling_mean(out, ["stn_id"], "dt_utc", "gust", AROUND, 0, LEAST, "rolling2b")
    out = T.rolling_mean(out, ["stn_id"], "dt_utc", "gust", 0, AROUND, LEAST, "rolling2a")
    return out.where("gust is not null").withColumns({f"wgr_{w}": X.quotient(F.col("gust"), F.col(f"rolling{w}")) for w in ("4", "2b", "2a")})


def severe(spark, sf_dir) -> DataFrame:
    return ratios(spark, sf_dir).where(X.scw_flag(F.col("gust"), F.col("wgr_4"), F.lit(1), STRONG, 2.0))


@query(_RATIOS + """, s0 AS (SELECT rid, dt_utc AS t, event_id AS id, gust FROM scw),
walk AS (SELECT rid, t, id, gust, t AS lo, 0 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY t, id) AS k FROM s0) WHERE k = 1
UNION ALL SELECT rid, n.t, n.id, n.gust, n.lo, n.kept FROM (SELECT w.rid AS rid, CASE WHEN w.kept = 1 THEN
 (SELECT min(struct_pack(a := 1, t := e.t, id := e.id, gust := e.gust, lo := e.t, kept := 0)) FROM s0 e WHERE e.rid = w.rid AND e.t >= w.t + INTERVAL 1 DAY AND e.t >= w.lo)
 ELSE coalesce((SELECT min(struct_pack(a := 1 - e.gust, t := e.t, id := e.id, gust := e.gust, lo := w.t + INTERVAL 1 DAY, kept := 0)) FROM s0 e
 WHERE e.rid = w.rid AND e.t >= w.lo AND e.t < w.t + INTERVAL 1 DAY AND e.gust > w.gust),
 struct_pack(a := 0.0::DOUBLE, t := w.t, id := w.id, gust := w.gust, lo := w.lo, kept := 1)) END AS n FROM walk w) WHERE n IS NOT NULL)
SELECT rid, month(t) AS month, count(*) AS n_events, round(max(gust), 6) AS max_gust FROM walk WHERE kept = 1 GROUP BY rid, month(t)""")
def severe_events(spark, sf_dir):
    """Severe gusts of each radar and month, one of a storm's gusts within a day."""
    kept = E.decluster_forward(severe(spark, sf_dir), ["rid"], "dt_utc", "gust", "event_id", DAY)
    return rounded(kept.groupBy("rid", F.month("dt_utc").alias("month")).agg(F.count("*").alias("n_events"), F.max("gust").alias("max_gust")))


@query(_RATIOS + " SELECT event_id, round(rolling4, 6) AS rolling4, round(rolling2b, 6) AS rolling2b, round(rolling2a, 6) AS rolling2a, round(gust / rolling4, 6) AS wgr_4, round(gust / rolling2b, 6) AS wgr_2b, round(gust / rolling2a, 6) AS wgr_2a FROM m")
def gust_ratios(spark, sf_dir):
    """Gusts over the means around, before and after them; rows without a gust go."""
    return rounded(ratios(spark, sf_dir).select("event_id", *[f"{c}{w}" for c in ("rolling", "wgr_") for w in ("4", "2b", "2a")]))


@query(ctes("obs") + f", m AS (SELECT *, CASE WHEN count(gust) OVER w >= 3 THEN avg(gust) OVER w END AS ahead, count(gust) OVER w AS n FROM obs WINDOW w AS ({_RANGE} CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)) SELECT event_id, round(ahead, 6) AS ahead, n AS in_window FROM m")
def leading_mean(spark, sf_dir):
    obs = view(spark, sf_dir, "obs")
    out = T.rolling_mean(obs, ["stn_id"], "dt_utc", "gust", 0, AROUND, LEAST, "ahead")
    return rounded(out.select("event_id", "ahead", F.count("gust").over(T.frame(["stn_id"], "dt_utc", 0, AROUND)).alias("in_window")))


@query(ctes("obs") + """, d AS (SELECT stn_id, date_trunc('day', dt_utc)::TIMESTAMP AS day, max(gust) AS gust FROM obs GROUP BY ALL), m AS (SELECT *, CASE WHEN count(gust) OVER w >= 2 AND max(day) OVER w = day + INTERVAL 2 DAY THEN avg(gust) OVER w END AS ahead
 FROM d WINDOW w AS (PARTITION BY stn_id ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)) SELECT stn_id, day, round(ahead, 6) AS ahead, round(gust / ahead, 6) AS ratio FROM m""")
def leading_mean_to_end(spark, sf_dir):
    """The mean of two days ahead of each day's gust, only where a row lies exactly at their end."""
    days = view(spark, sf_dir, "obs").groupBy("stn_id", F.date_trunc("day", "dt_utc").cast("timestamp_ntz").alias("day")).agg(F.max("gust").alias("gust"))
    out = T.rolling_mean(days, ["stn_id"], "day", "gust", 0, AROUND, 2, "ahead", require_end=True)
    return rounded(out.select("stn_id", "day", "ahead", X.quotient(F.col("gust"), F.col("ahead")).alias("ratio")))


@query(ctes("obs") + " SELECT event_id, CASE WHEN count(*) OVER w >= 2 THEN round(median(gust) OVER w, 6) END AS mid FROM obs WINDOW w AS (PARTITION BY stn_id ORDER BY dt_utc RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING)")
def centered_median(spark, sf_dir):
    return rounded(T.rolling_median(view(spark, sf_dir, "obs"), ["stn_id"], "dt_utc", "gust", DAY, DAY, 2, "mid").select("event_id", "mid"))


@query(ctes("obs") + ", m AS (SELECT stn_id, CASE WHEN count(*) OVER w >= 2 THEN min(gust) OVER w END AS low FROM obs WINDOW w AS (PARTITION BY stn_id ORDER BY dt_utc RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 0 DAY FOLLOWING)) SELECT stn_id, max(low) AS highest_low FROM m GROUP BY stn_id")
def rolling_min_max(spark, sf_dir):
    w = T.frame(["stn_id"], "dt_utc", DAY, 0)
    low = view(spark, sf_dir, "obs").select("stn_id", F.when(F.count("*").over(w) >= 2, F.min("gust").over(w)).alias("low"))
    return low.groupBy("stn_id").agg(F.max("low").alias("highest_low"))


@query(ctes("obs") + " SELECT event_id, round(count(*) OVER (PARTITION BY stn_id ORDER BY dt_utc RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 2 DAY FOLLOWING) / 8.0, 6) AS share FROM obs")
def window_completeness(spark, sf_dir):
    return rounded(view(spark, sf_dir, "obs").select("event_id", T.completeness(None, ["stn_id"], "dt_utc", AROUND, AROUND, 8).alias("share")))


_HOLES = ctes("obs") + ", s AS (SELECT stn_id, rid, dt_utc, CASE WHEN event_id % 4 <> 0 THEN gust END AS g FROM obs), e AS (SELECT * FROM obs WHERE gust >= 100)"
WINDOWS = {"before": (AROUND, 0), "after": (0, AROUND), "around": (AROUND, AROUND), "narrow": (DAY / 2, DAY / 2)}


def series(spark, sf_dir) -> DataFrame:
    """The gusts as a series with missing values."""
    return view(spark, sf_dir, "obs").select("stn_id", "rid", "dt_utc", F.when(F.col("event_id") % 4 != 0, F.col("gust")).alias("g"))


def strong(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "obs").where("gust >= 100").select("event_id", "stn_id", "rid", "dt_utc", "gust")


def _inside(before, after):
    return f"s.dt_utc BETWEEN e.dt_utc - INTERVAL {int(before)} SECOND AND e.dt_utc + INTERVAL {int(after)} SECOND"


@query(_HOLES + ", j AS (SELECT e.event_id, any_value(e.gust) AS gust, " + ", ".join(f"count(g) FILTER (WHERE {_inside(*w)}) AS n_{k}, count(*) FILTER (WHERE {_inside(*w)} AND s.stn_id IS NOT NULL AND g IS NULL) AS miss_{k}, avg(g) FILTER (WHERE {_inside(*w)}) AS m_{k}" for k, w in WINDOWS.items()) + f""" FROM e LEFT JOIN s ON s.stn_id = e.stn_id AND {_inside(AROUND, AROUND)} GROUP BY e.event_id)
SELECT event_id, n_around AS n, round(CASE WHEN miss_before < 2 THEN gust / m_before END, 6) AS before_ratio, round(CASE WHEN miss_after < 2 THEN gust / m_after END, 6) AS after_ratio, round(gust / m_around, 6) AS around_ratio, round(gust / m_narrow, 6) AS narrow_ratio FROM j""")
def event_window_ratios(spark, sf_dir):
    """Peak over the means before, after, around and close around an event; those to one side are null where two values or more are missing."""
    found = T.windows_sums(strong(spark, sf_dir), series(spark, sf_dir), ["stn_id"], "event_id", "dt_utc", "dt_utc", "g", WINDOWS)
    over = lambda k: X.quotient(F.col("gust"), F.col(f"mean_{k}"))
    sides = [F.when(F.col(f"missing_{k}") < 2, over(k)).alias(f"{k}_ratio") for k in ("before", "after")]
    return rounded(found.select("event_id", F.col("n_around").alias("n"), *sides, over("around").alias("around_ratio"), over("narrow").alias("narrow_ratio")))


@query(_HOLES + f" SELECT e.event_id, count(g) AS n, round(CASE WHEN count(*) FILTER (WHERE s.stn_id IS NOT NULL AND g IS NULL) < 2 THEN sum(g) END, 6) AS total FROM e LEFT JOIN s ON s.stn_id = e.stn_id AND {_inside(0, DAY)} GROUP BY e.event_id")
def precip_after(spark, sf_dir):
    """The total of the day after an event, null where two values or more are missing."""
    found = T.window_sums(strong(spark, sf_dir), series(spark, sf_dir), ["stn_id"], "event_id", "dt_utc", "dt_utc", "g", 0, DAY)
    return rounded(found.select("event_id", "n", F.when(F.col("missing") < 2, F.col("total")).alias("total")))


@query(_HOLES + f" SELECT e.event_id, count(g) AS n, round(coalesce(sum(g), 0), 6) AS strokes FROM e LEFT JOIN s ON s.rid = e.rid AND {_inside(1800, 1800)} GROUP BY e.event_id")
def strokes_around(spark, sf_dir):
    """The sum of half an hour before and after an event; 0 where there is none."""
    found = T.window_sums(strong(spark, sf_dir), series(spark, sf_dir), ["rid"], "event_id", "dt_utc", "dt_utc", "g", 1800, 1800)
    return rounded(found.select("event_id", "n", F.coalesce("total", F.lit(0.0)).alias("strokes")))


_GOOD = ctes("obs", "scan_at_station")


@query(_GOOD + """, b AS (SELECT o.event_id, o.stn_id, o.dt_utc, max(s.scan_time) AS st FROM obs o JOIN scan_at_station s ON s.stn_no = o.stn_id AND s.scan_time <= o.dt_utc WHERE o.q = 'Y' GROUP BY ALL)
SELECT event_id, s.scan, s.uid10, s.in10km FROM b JOIN scan_at_station s ON s.stn_no = b.stn_id AND s.scan_time = b.st
WHERE date_diff('microsecond', st, dt_utc) <= 43200000000 AND dt_utc <= (SELECT max(scan_time) FROM scan_at_station z WHERE z.stn_no = b.stn_id)""")
def asof_gust_to_scan(spark, sf_dir):
    scans = view(spark, sf_dir, "scan_at_station").withColumnRenamed("stn_no", "stn_id")
    return T.asof_join(view(spark, sf_dir, "obs").where("q = 'Y'"), scans, ["stn_id"], "dt_utc", "scan_time", ["scan", "uid10", "in10km"], DAY / 2, clip_to_last=True).select("event_id", "scan", "uid10", "in10km")


@query(_GOOD + """, b AS (SELECT o.event_id, max(s.scan_time) AS st, o.dt_utc FROM obs o JOIN scan_at_station s ON s.stn_no = o.stn_id AND s.scan_time <= o.dt_utc GROUP BY ALL)
SELECT event_id, -1 AS uid10, 0 AS in10km FROM b WHERE date_diff('microsecond', st, dt_utc) <= 43200000000""")
def null_storm_fill(spark, sf_dir):
    scans = view(spark, sf_dir, "scan_at_station").select(F.col("stn_no").alias("stn_id"), "scan_time")
    return T.asof_join(view(spark, sf_dir, "obs"), scans, ["stn_id"], "dt_utc", "scan_time", [], DAY / 2).select("event_id", F.lit(-1).alias("uid10"), F.lit(0).alias("in10km"))


@query(_GOOD + """, p AS (SELECT o.event_id, s.scan, row_number() OVER (PARTITION BY o.event_id ORDER BY abs(date_diff('microsecond', s.scan_time, o.dt_utc)), s.scan_time) AS k,
 abs(date_diff('microsecond', s.scan_time, o.dt_utc)) AS gap FROM obs o JOIN scan_at_station s ON s.stn_no = o.stn_id) SELECT event_id, scan FROM p WHERE k = 1 AND gap <= 21600000000""")
def nearest_time(spark, sf_dir):
    scans = view(spark, sf_dir, "scan_at_station").withColumnRenamed("stn_no", "stn_id")
    return T.nearest_time(view(spark, sf_dir, "obs"), scans, ["stn_id"], "dt_utc", "scan_time", "scan", DAY / 4).select("event_id", "scan")


@query(ctes("obs") + """, m AS (SELECT stn_id, date_trunc('minute', dt_utc) AS slot, arg_max(gust, dt_utc) AS g FROM obs GROUP BY ALL), s AS (SELECT stn_id, unnest(generate_series(min(slot), max(slot), INTERVAL 1 MINUTE)) AS slot FROM m GROUP BY stn_id),
f AS (SELECT s.stn_id, s.slot, last_value(g IGNORE NULLS) OVER (PARTITION BY s.stn_id ORDER BY s.slot ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS g FROM s LEFT JOIN m ON m.stn_id = s.stn_id AND m.slot = s.slot)
SELECT stn_id, count(*) AS minutes, count(g) AS filled, round(sum(g), 6) AS total FROM f GROUP BY stn_id""")
def resample_ffill(spark, sf_dir):
    """Every minute from a station's first to its last gust, filled forward for ten minutes, as the reference does."""
    filled = T.regular_fill(view(spark, sf_dir, "obs"), ["stn_id"], "dt_utc", "gust", "1 minute", "minute", 10)
    return rounded(filled.groupBy("stn_id").agg(F.count("*").alias("minutes"), F.count("gust").alias("filled"), F.sum("gust").alias("total")))


@query(ctes("obs") + """, n AS (SELECT *, row_number() OVER (PARTITION BY stn_id ORDER BY dt_utc) AS k, CASE WHEN event_id % 4 <> 0 THEN gust END AS g FROM obs),
w AS (SELECT *, max(CASE WHEN g IS NOT NULL THEN k END) OVER (PARTITION BY stn_id ORDER BY k) AS ka, min(CASE WHEN g IS NOT NULL THEN k END) OVER (PARTITION BY stn_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM n)
SELECT w.event_id, round(CASE WHEN w.g IS NOT NULL THEN w.g WHEN kb IS NULL THEN a.g ELSE a.g + (b.g - a.g) * (w.k - ka) / (kb - ka) END, 6) AS filled
FROM w LEFT JOIN n a ON a.stn_id = w.stn_id AND a.k = ka LEFT JOIN n b ON b.stn_id = w.stn_id AND b.k = kb""")
def interpolate_linear(spark, sf_dir):
    gaps = view(spark, sf_dir, "obs").withColumn("filled", F.when(F.col("event_id") % 4 != 0, F.col("gust")))
    return rounded(T.interpolate_linear(gaps, ["stn_id"], "dt_utc", "filled").select("event_id", "filled"))


@query(ctes("obs") + " SELECT event_id, round(sum(gust) OVER (PARTITION BY stn_id ORDER BY dt_utc ROWS UNBOUNDED PRECEDING), 4) AS running FROM obs")
def running_total(spark, sf_dir):
    return rounded(T.running_total(view(spark, sf_dir, "obs"), ["stn_id"], ["dt_utc"], "gust", "running").select("event_id", "running"), 4)


@query(ctes("obs") + " SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN gust END IGNORE NULLS) OVER (PARTITION BY stn_id ORDER BY dt_utc ROWS UNBOUNDED PRECEDING) AS carried FROM obs")
def pad_fill(spark, sf_dir):
    known = F.when(F.col("event_id") % 3 == 0, F.col("gust"))
    return T.pad_fill(view(spark, sf_dir, "obs"), ["stn_id"], ["dt_utc"], known, "carried").select("event_id", "carried")


@query(ctes("obs") + """, s AS (SELECT rid, unnest(generate_series(min(date_trunc('hour', dt_utc)), max(date_trunc('hour', dt_utc)), INTERVAL 1 HOUR)) AS slot FROM obs GROUP BY rid)
SELECT s.rid, s.slot, count(DISTINCT stn_id) AS n FROM s LEFT JOIN obs o ON o.rid = s.rid AND date_trunc('hour', o.dt_utc) = s.slot GROUP BY ALL""")
def resample_count_distinct(spark, sf_dir):
    counted = T.resample_count_distinct(view(spark, sf_dir, "obs"), ["rid"], "dt_utc", "stn_id", "hour")
    return counted.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


#: Ranks within radars, regions, storm classes and overall.
_GROUPS = {"radar": ("rid", "rid"), "region": ("rid % 5", "rid % 5"), "class": ("event_id % 6", "event_id % 6"), "all": ("0", "0")}


@query(ctes("obs") + " " + " UNION ALL ".join(f"SELECT '{n}' AS kind, event_id, row_number() OVER (PARTITION BY {sql} ORDER BY gust DESC, event_id) AS rank_desc, round(row_number() OVER (PARTITION BY {sql} ORDER BY gust, event_id) / (count(*) OVER (PARTITION BY {sql}) + 1), 6) AS p FROM obs" for n, (sql, _) in _GROUPS.items()))
def rank_nonexceed(spark, sf_dir):
    """Ranks of gusts and their chance of non-exceedance, in each radar, region and class and overall; equal gusts are ranked by id."""
    groups = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.expr(text).cast("long").alias("of")) for n, (_, text) in _GROUPS.items()]))
    each = view(spark, sf_dir, "obs").select("event_id", "gust", groups.alias("g")).select("event_id", "gust", "g.kind", "g.of")
    return rounded(K.ranks(each, ["kind", "of"], "gust", "event_id").select("kind", "event_id", "rank_desc", "p"))


_FLAG = ctes("obs") + ", f AS (SELECT *, CASE WHEN gust >= 100 THEN 1 ELSE 0 END AS scw FROM obs)"


def flagged(spark, sf_dir):
    return view(spark, sf_dir, "obs").withColumn("scw", (F.col("gust") >= 100).cast("int"))


@query(_FLAG + ", k AS (SELECT *, row_number() OVER (PARTITION BY rid, date_trunc('hour', dt_utc) ORDER BY scw DESC, gust DESC, event_id) AS n FROM f) SELECT event_id, rid, gust FROM k WHERE n = 1 AND scw = 0")
def non_events(spark, sf_dir):
    keyed = flagged(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "dt_utc"))
    return E.non_events(keyed, ["rid", "hour"], [F.desc("scw"), F.desc("gust"), F.asc("event_id")]).select("event_id", "rid", "gust")


@query(ctes("obs") + """, a AS (SELECT *, row_number() OVER (PARTITION BY stn_id ORDER BY gust DESC, event_id) AS k FROM obs), b AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', dt_utc) ORDER BY gust DESC, event_id) AS n FROM a WHERE k = 1)
SELECT event_id, stn_id, gust FROM b WHERE n = 1""")
def top1_chain(spark, sf_dir):
    order = [F.desc("gust"), F.asc("event_id")]
    first = E.top1(view(spark, sf_dir, "obs"), ["stn_id"], order).withColumn("day", F.date_trunc("day", "dt_utc"))
    return E.top1(first, ["day"], order).select("event_id", "stn_id", "gust")


@query(_GOOD + ", k AS (SELECT *, row_number() OVER (PARTITION BY stn_no, date_trunc('day', scan_time) ORDER BY scan_time, scan) AS n FROM scan_at_station) SELECT scan, stn_no FROM k WHERE n = 1")
def dedupe_first(spark, sf_dir):
    scans = view(spark, sf_dir, "scan_at_station").withColumn("day", F.date_trunc("day", "scan_time"))
    return E.top1(scans, ["stn_no", "day"], [F.asc("scan_time"), F.asc("scan")]).select("scan", "stn_no")


@query(ctes("obs", recursive=True) + """, s AS (SELECT * FROM obs WHERE gust >= 60), seeds AS (SELECT stn_id, min(dt_utc) AS t FROM s GROUP BY stn_id UNION ALL
 SELECT stn_id, n FROM (SELECT p.stn_id, (SELECT min(e.dt_utc) FROM s e WHERE e.stn_id = p.stn_id AND e.dt_utc >= p.t + INTERVAL 1 DAY) AS n FROM seeds p) WHERE n IS NOT NULL),
g AS (SELECT s.*, (SELECT max(t) FROM seeds d WHERE d.stn_id = s.stn_id AND d.t <= s.dt_utc) AS seed FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY stn_id, seed ORDER BY gust DESC, event_id) AS n FROM g)
SELECT event_id, seed FROM k WHERE n = 1""")
def decluster_group(spark, sf_dir):
    grouped = E.decluster_group(view(spark, sf_dir, "obs").where("gust >= 60"), ["stn_id"], "dt_utc", "gust", "event_id", DAY)
    return E.top1(grouped, ["stn_id", "seed"], [F.desc("gust"), F.asc("event_id")]).select("event_id", "seed")


@query(ctes("obs") + " SELECT event_id, gust FROM obs ORDER BY gust DESC, event_id LIMIT 20")
def top_n_gusts(spark, sf_dir):
    return view(spark, sf_dir, "obs").orderBy(F.desc("gust"), "event_id").limit(20).select("event_id", "gust")


@query(ctes("obs") + """, c AS (SELECT event_id, gust, CASE WHEN event_id % 5 = 0 THEN 'no storm' ELSE 'class ' || event_id % 6 END AS list FROM obs),
k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY gust DESC, event_id) AS place FROM c) SELECT list, place, event_id, gust FROM k WHERE place <= 5""")
def top_n_gusts_by_class(spark, sf_dir):
    """The strongest gusts of each storm class and of those without a storm."""
    named = F.when(F.col("event_id") % 5 == 0, "no storm").otherwise(F.concat(F.lit("class "), (F.col("event_id") % 6).cast("string")))
    c = view(spark, sf_dir, "obs").select("event_id", "gust", named.alias("list"))
    return E.top_n(c, ["list"], F.struct((-F.col("gust")).alias("g"), "event_id"), ["event_id", "gust"], 5).select("list", "place", "event_id", "gust")


_CASES = ctes("obs") + """, c AS (SELECT event_id, stn_id, gust, event_id % 5 = 0 AS stormless, event_id % 7 = 0 AS radarless FROM obs),
k AS (SELECT *, row_number() OVER (PARTITION BY stn_id, stormless, radarless ORDER BY gust DESC, event_id) AS n FROM c),
own AS (SELECT stn_id, count(*) FILTER (WHERE NOT stormless AND NOT radarless AND n <= 9) AS have FROM k GROUP BY stn_id),
filled AS (SELECT k.event_id FROM own o JOIN k ON k.stn_id = o.stn_id + 1 WHERE NOT stormless AND NOT radarless AND n <= 9 - o.have)"""


@query(_CASES + """ SELECT event_id, stn_id AS location, CASE WHEN radarless THEN 4 WHEN stormless THEN 3 WHEN n <= 9 THEN 1 ELSE 2 END AS label FROM k
UNION ALL SELECT event_id, stn_id - 1, 5 FROM k SEMI JOIN filled USING (event_id)""")
def pick_cases(spark, sf_dir):
    """Cases per station: 1 chosen (the nine strongest with storm data), 2 others, 3 without storm, 4 without radar; 5 fills up a
    station with fewer than nine from its fallback station, the next one, strongest first."""
    df = view(spark, sf_dir, "obs").select("event_id", F.col("stn_id").alias("location"), "gust", (F.col("event_id") % 5 == 0).alias("stormless"), (F.col("event_id") % 7 == 0).alias("radarless"))
    return E.pick_cases(df, "location", F.col("location") - 1, [F.desc("gust"), F.asc("event_id")], 9).select("event_id", "location", "label")


@query(ctes("obs") + """ SELECT event_id, date_trunc('hour', dt_utc) AS hour, date_trunc('day', dt_utc) AS day, year(dt_utc) AS yr, month(dt_utc) AS mon, hour(dt_utc) AS hr,
 strftime(dt_utc, '%Y%m%d%H%M%S') || '/' || stn_id AS gid, lpad(CAST(stn_id AS VARCHAR), 6, '0') AS padded, last_day(dt_utc) AS month_end,
 make_timestamp(CAST(round_even(epoch_us(dt_utc) / 60000000.0, 0) AS BIGINT) * 60000000) AS minute FROM obs""")
def calendar_parts(spark, sf_dir):
    t = F.col("dt_utc")
    return view(spark, sf_dir, "obs").select(
        "event_id", X.floor_to(t, "hour").cast("timestamp_ntz").alias("hour"), X.floor_to(t, "day").cast("timestamp_ntz").alias("day"), F.year(t).cast("long").alias("yr"), F.month(t).cast("long").alias("mon"), F.hour(t).cast("long").alias("hr"),
        X.group_id(t, F.col("stn_id")).alias("gid"), F.lpad(F.col("stn_id").cast("string"), 6, "0").alias("padded"), F.last_day(t).alias("month_end"), X.to_minute(t).alias("minute"),
    )


@query(ctes("obs") + " SELECT rid, min(month_start) AS first_month, count(*) AS months FROM (SELECT rid, unnest(generate_series(date_trunc('month', min(dt_utc)) - INTERVAL 11 MONTH, date_trunc('month', max(dt_utc)), INTERVAL 1 MONTH))::DATE AS month_start FROM obs GROUP BY rid) GROUP BY rid")
def month_sequence(spark, sf_dir):
    spans = view(spark, sf_dir, "obs").groupBy("rid").agg(F.min("dt_utc").alias("a"), F.max("dt_utc").alias("b"))
    months = spans.select("rid", F.explode(F.expr("sequence(add_months(trunc(cast(a as date), 'MM'), -11), trunc(cast(b as date), 'MM'), interval 1 month)")).alias("m"))
    return months.groupBy("rid").agg(F.min("m").alias("first_month"), F.count("*").alias("months"))


@query(ctes("obs") + ", bad AS (SELECT dt_utc FROM obs WHERE gust > 200) SELECT count(*) AS n, round(sum(gust), 4) AS total FROM obs WHERE dt_utc NOT IN (SELECT dt_utc FROM bad)")
def drop_suspect_gusts(spark, sf_dir):
    obs = view(spark, sf_dir, "obs")
    return rounded(obs.join(obs.where("gust > 200").select("dt_utc"), "dt_utc", "left_anti").agg(F.count("*").alias("n"), F.sum("gust").alias("total")), 4)


@query(ctes("obs") + " SELECT stn_id, count(*) AS n, round(sum(gust), 4) AS total FROM obs WHERE q = 'Y' AND month(dt_utc) = 1 GROUP BY stn_id")
def load_gusts(spark, sf_dir):
    return rounded(view(spark, sf_dir, "obs").where((F.col("q") == "Y") & (F.month("dt_utc") == 1)).groupBy("stn_id").agg(F.count("*").alias("n"), F.sum("gust").alias("total")), 4)


@query(ctes("obs") + ", e AS (SELECT DISTINCT stn_id FROM obs WHERE gust >= 200) SELECT count(*) FILTER (WHERE stn_id IN (SELECT stn_id FROM e)) AS near_events, count(*) FILTER (WHERE stn_id NOT IN (SELECT stn_id FROM e)) AS near_none FROM obs")
def semi_anti(spark, sf_dir):
    by = view(spark, sf_dir, "obs").groupBy("stn_id").agg(F.count("*").alias("n"), F.bool_or(F.col("gust") >= 200).alias("hit"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return by.agg(total(F.col("hit")).alias("near_events"), total(~F.coalesce("hit", F.lit(False))).alias("near_none"))


@query(ctes("obs") + ", o AS (SELECT *, event_id % 97 AS uid FROM obs), h AS (SELECT rid, date_trunc('hour', dt_utc) AS hour, count(DISTINCT stn_id) AS stations FROM o GROUP BY ALL), u AS (SELECT uid, count(DISTINCT stn_id) AS of_storm FROM o GROUP BY uid) SELECT event_id, stations, of_storm FROM o JOIN h ON h.rid = o.rid AND h.hour = date_trunc('hour', dt_utc) JOIN u ON u.uid = o.uid")
def stations_per_event(spark, sf_dir):
    """Stations that measured something in the event's hour and radar, and in the event's storm."""
    obs = view(spark, sf_dir, "obs").withColumns({"hour": F.date_trunc("hour", "dt_utc"), "uid": F.col("event_id") % 97})
    return C.attach_counts(obs, "stn_id", {"stations": ["rid", "hour"], "of_storm": ["uid"]}).select("event_id", "stations", "of_storm")


@query(ctes("obs") + ", " + sql_drawn("obs", {"wt": ("1", 1.0)}, ["event_id"], 50, "w") + """,
b AS (SELECT rid, replicate, min(gust) AS loc, sum(gust * wt) / sum(wt) - min(gust) AS scale FROM w GROUP BY ALL),
q AS (SELECT rid, round(quantile_cont(loc - scale * ln(0.01), 0.05), 6) AS low, round(quantile_cont(loc - scale * ln(0.01), 0.95), 6) AS high FROM b GROUP BY rid),
f AS (SELECT rid, round(min(gust), 6) AS loc, round(avg(gust) - min(gust), 6) AS scale, round(min(gust) - (avg(gust) - min(gust)) * ln(0.01), 6) AS level_100 FROM obs GROUP BY rid) SELECT * FROM f JOIN q USING (rid)""")
def expon_fit(spark, sf_dir):
    """Exponential fits of each radar's gusts, their level of one in a hundred, and its 5 and 95 % over fifty bootstrap replicates."""
    obs = view(spark, sf_dir, "obs")
    level = K.expon_level(F.col("loc"), F.col("scale"), 0.01).alias("level_100")
    drawn = K.expon_fit(bootstrap_rows(obs, "event_id", 50), ["rid", "replicate"], "gust", "weight").select("rid", level)
    band = drawn.groupBy("rid").agg(F.percentile("level_100", 0.05).alias("low"), F.percentile("level_100", 0.95).alias("high"))
    return rounded(K.expon_fit(obs, ["rid"], "gust").select("*", level).join(band, "rid"))
