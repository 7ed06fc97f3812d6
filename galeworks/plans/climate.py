"""Climatology: days, seasons, classes, distributions and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeworks.functions import exprs as X
from galeworks.operators import climate as C
from galeworks.operators.ordered import exact_quantiles
from galeworks.plans.registry import query
from galeworks.plans.views import ctes, rounded, view

TRACKS, SKILL, ENSEMBLE = ctes("tracks"), ctes("skill"), ctes("ensemble")


_FLAGS = {"strong": "l_quantity > 45", "moist": "l_discount > 0.08", "dear": "l_extendedprice > 40000", "taxed": "l_tax >= 0.08", "returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "mixed": "l_quantity > 30 AND l_discount > 0.05"}


@query("WITH d AS (SELECT l_partkey % 50 AS point, date_trunc('day', l_shipdate) AS day, " + ", ".join(f"bool_or({c}) AS {n}" for n, c in _FLAGS.items()) + " FROM lineitem GROUP BY ALL) SELECT point, year(day)::INTEGER AS yr, month(day)::INTEGER AS mon, " + ", ".join(f"count_if({n})::BIGINT AS {n}" for n in _FLAGS) + " FROM d GROUP BY ALL")
def days_per_month(spark, sf_dir):
    """Days of a month on which each of seven flags holds at any step."""
    li = view(spark, sf_dir, "lineitem").withColumn("point", F.col("l_partkey") % 50)
    return C.days_per_month(li, ["point"], F.col("l_shipdate"), {n: F.expr(c) for n, c in _FLAGS.items()})


@query(SKILL + " SELECT cluster, yr::INTEGER AS yr, mon::INTEGER AS mon, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM skill GROUP BY ALL")
def fraction_per_month(spark, sf_dir):
    return rounded(view(spark, sf_dir, "skill").groupBy("cluster", F.col("yr").cast("int").alias("yr"), F.col("mon").cast("int").alias("mon")).agg(F.avg((F.col("l_quantity") > 25).cast("double")).alias("share")))


_GAPS = ctes("env") + ", g AS (SELECT h, i, j, CASE WHEN (i * 7 + j + h) % 5 = 0 THEN NULL ELSE s06 END AS s06 FROM env)"


@query(_GAPS + ", f AS (SELECT i, j, arg_min(CASE WHEN s06 IS NULL THEN 1 ELSE 0 END, h) AS gone FROM g GROUP BY i, j) SELECT h, i, j, round(CASE WHEN gone = 0 THEN s06 END, 6) AS s06 FROM g JOIN f USING (i, j)")
def mask_missing_points(spark, sf_dir):
    gaps = view(spark, sf_dir, "env").select("h", "i", "j", F.when((F.col("i") * 7 + F.col("j") + F.col("h")) % 5 != 0, F.col("s06")).alias("s06"))
    return rounded(C.mask_missing_points(gaps, ["i", "j"], "h", "s06").select("h", "i", "j", "s06"))


@query(TRACKS + " SELECT count(DISTINCT (year(time), month(time), uid))::BIGINT AS storms FROM tracks")
def unique_parent_storms(spark, sf_dir):
    return view(spark, sf_dir, "tracks").select(F.count_distinct(F.year("time"), F.month("time"), F.col("uid")).alias("storms"))


@query("WITH o AS (SELECT user_id % 25 AS rid, event_type FROM events WHERE value > 60) SELECT n_regionkey AS region, rid, event_type, count(*)::BIGINT AS n FROM o JOIN nation ON n_nationkey = rid GROUP BY ROLLUP (n_regionkey, rid, event_type)")
def count_by(spark, sf_dir):
    o = view(spark, sf_dir, "events").where("value > 60").select((F.col("user_id") % 25).alias("rid"), "event_type")
    regions = view(spark, sf_dir, "radars").select("rid", "region")
    return o.join(regions, "rid").rollup("region", "rid", "event_type").agg(F.count("*").alias("n"))


@query(SKILL + " SELECT cluster, round(count_if(scw = 1 AND l_discount > 0.05) / nullif(count_if(scw = 1), 0), 6) AS events, round(count_if(scw = 0 AND in10km = 1 AND l_discount > 0.05) / nullif(count_if(scw = 0 AND in10km = 1), 0), 6) AS storms, round(count_if(scw = 0 AND l_discount > 0.05) / nullif(count_if(scw = 0), 0), 6) AS nulls FROM skill GROUP BY GROUPING SETS ((), (cluster))")
def lightning_probability(spark, sf_dir):
    hit, near, flash = F.col("scw") == 1, F.col("in10km") == 1, F.col("l_discount") > 0.05
    return rounded(C.conditional_shares(view(spark, sf_dir, "skill"), [[], ["cluster"]], {"events": (flash, hit), "storms": (flash, ~hit & near), "nulls": (flash, ~hit)}))


@query(SKILL + ", c AS (SELECT scw, cluster, mon, count(*) AS n FROM skill GROUP BY ALL) SELECT scw::INTEGER AS scw, cluster, mon::INTEGER AS mon, n::BIGINT AS n, round(n / sum(n) OVER (), 8) AS frequency FROM c")
def cycle_histogram(spark, sf_dir):
    s = view(spark, sf_dir, "skill").select(F.col("scw").cast("int").alias("scw"), "cluster", F.col("mon").cast("int").alias("mon"))
    return rounded(C.share_of_all(s, ["scw", "cluster", "mon"], "frequency"), 8)


@query(ctes("obs") + ", c AS (SELECT CASE WHEN gust >= 100 THEN 1 ELSE 0 END AS scw, stn_id % 3 AS cluster, hour(dt_utc + CASE WHEN rid % 2 = 0 THEN INTERVAL 10 HOUR ELSE INTERVAL 8 HOUR END) AS hr, count(*) AS n FROM obs GROUP BY ALL) SELECT scw::INTEGER AS scw, cluster, hr::INTEGER AS hr, n::BIGINT AS n, round(n / sum(n) OVER (), 8) AS frequency FROM c")
def local_hour_histogram(spark, sf_dir):
    """Events and background of each cluster by the radar's local hour, as shares of all rows."""
    local = X.local_time(F.col("dt_utc").cast("timestamp"), F.when(F.col("rid") % 2 == 0, "+10:00").otherwise("+08:00"))
    s = view(spark, sf_dir, "obs").select((F.col("gust") >= 100).cast("int").alias("scw"), (F.col("stn_id") % 3).alias("cluster"), F.hour(local).alias("hr"))
    return rounded(C.share_of_all(s, ["scw", "cluster", "hr"], "frequency"), 8)


_CLASS = "CASE WHEN max_alt >= 7 AND azi_shear > 4 AND major_axis_length >= 100 THEN 'Embedded supercell' WHEN max_alt >= 7 AND azi_shear > 4 AND major_axis_length < 100 THEN 'Supercellular' WHEN major_axis_length < 100 AND local_max >= 2 THEN 'Cell cluster' WHEN local_max = 1 THEN 'Cellular' WHEN major_axis_length >= 100 AND major_axis_length / minor_axis_length < 3 THEN 'Non-linear' WHEN major_axis_length >= 100 AND major_axis_length / minor_axis_length >= 3 THEN 'Linear' END"
_TYPED = TRACKS + f", typed AS (SELECT *, {_CLASS} AS class, CASE WHEN speed > 25 THEN 1 ELSE 0 END AS scw, uid % 3 AS cluster FROM tracks)"


def typed(spark, sf_dir):
    return view(spark, sf_dir, "tracks").withColumns({"class": X.storm_class(), "scw": (F.col("speed") > 25).cast("int"), "cluster": F.col("uid") % 3})


@query(_TYPED + ", c AS (SELECT cluster, class, sum(scw)::BIGINT AS events, count(*) AS n FROM typed GROUP BY GROUPING SETS ((class), (cluster, class))) SELECT cluster, class, events, round(events / nullif(sum(events) OVER (PARTITION BY cluster), 0), 6) AS share, round(100.0 * events / n, 6) AS rate, round(events / nullif(n - events, 0), 6) AS odds FROM c")
def class_frequency(spark, sf_dir):
    """Of each storm class, over all rows (cluster null) and in each cluster: its share of the events, its event rate, and events over non-events."""
    return rounded(C.class_frequency(typed(spark, sf_dir), ["cluster"], "class", "scw"))


NAMES = ["Embedded supercell", "Supercellular", "Cell cluster", "Cellular", "Non-linear", "Linear"]


@query(_TYPED + " SELECT cluster, " + ", ".join(f"nullif(count_if(class = '{n}'), 0)::BIGINT AS \"{n}\"" for n in NAMES) + " FROM typed GROUP BY cluster")
def crosstab(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("cluster").pivot("class", NAMES).count()


@query(SKILL + ", q AS (SELECT cluster, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.75) AS q75 FROM skill GROUP BY cluster) SELECT cluster, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(min(x), 4) AS low, round(max(x), 4) AS high, min(v) AS least, max(v) AS most FROM (SELECT q.*, l_extendedprice AS v, CASE WHEN l_extendedprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) THEN l_extendedprice END AS x FROM skill JOIN q USING (cluster)) GROUP BY ALL")
def box_summary(spark, sf_dir):
    return rounded(C.box_summary(view(spark, sf_dir, "skill"), ["cluster"], "l_extendedprice"), 4)


@query(SKILL + """, b AS (SELECT least(floor(l_quantity * 10 / 50), 9)::BIGINT AS bx, least(floor(l_extendedprice * 12 / 60000), 11)::BIGINT AS "by", count(*) AS n FROM skill WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 60000 GROUP BY ALL)
 SELECT x AS bx, y AS "by", coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS percent FROM range(10) AS a(x) CROSS JOIN range(12) AS c(y) LEFT JOIN b ON b.bx = x AND b."by" = y""")
def hist2d(spark, sf_dir):
    return rounded(C.hist2d(view(spark, sf_dir, "skill"), C.bins(F.col("l_quantity"), 0, 50, 10), C.bins(F.col("l_extendedprice"), 0, 60000, 12), 10, 12))


@query(ctes("stations") + ", r AS (SELECT n_nationkey AS rid, 1995 + n_nationkey % 10 AS r1, 2012 + n_nationkey % 8 AS r2 FROM nation) SELECT rid, round(sum((least(y2, r2) - greatest(y1, r1) + 1) * qc_pct / 100), 6) AS years FROM stations JOIN r ON rid = stn_no % 25 WHERE least(y2, r2) >= greatest(y1, r1) GROUP BY rid")
def station_years(spark, sf_dir):
    radars = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rid"), (1995 + F.col("n_nationkey") % 10).alias("r1"), (2012 + F.col("n_nationkey") % 8).alias("r2"))
    both = view(spark, sf_dir, "stations").withColumn("rid", F.col("stn_no") % 25).join(radars, "rid")
    first, last = F.greatest("y1", "r1"), F.least("y2", "r2")
    return rounded(C.station_years(both.where(last >= first), ["rid"], first, last, F.col("qc_pct")).select("rid", "years"))


@query(_TYPED + " SELECT cluster, scw::INTEGER AS scw, round(100.0 * count_if(nullif(azi_shear, 0) IS NULL) / count(*), 6) AS missing FROM typed GROUP BY cluster, scw")
def missing_share(spark, sf_dir):
    """Percent of the events and of the non-events of each cluster that have no shear."""
    none = F.nullif(F.col("azi_shear"), F.lit(0.0)).isNull()
    return rounded(C.conditional_shares(typed(spark, sf_dir), [["cluster", "scw"]], {"missing": (none, None)}, 100.0))


_RANK = "rank() OVER (PARTITION BY cluster ORDER BY {0}) + (count(*) OVER (PARTITION BY cluster, {0}) - 1) / 2"


@query(SKILL + f", r AS (SELECT cluster, {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b FROM skill) SELECT cluster, round(corr(a, b), 6) AS spearman FROM r GROUP BY cluster")
def spearman(spark, sf_dir):
    ranked = C.mid_rank(C.mid_rank(view(spark, sf_dir, "skill").select("cluster", "l_quantity", "l_extendedprice"), ["cluster"], "l_quantity", "a"), ["cluster"], "l_extendedprice", "b")
    return rounded(ranked.groupBy("cluster").agg(F.corr("a", "b").alias("spearman")))


@query(ENSEMBLE + ", s AS (SELECT model, point, (mon % 12) // 3 AS season, sum(days) / count(DISTINCT yr) AS d FROM ensemble WHERE experiment = 'past' GROUP BY ALL) SELECT point, season::INTEGER AS season, round(median(d), 6) AS days FROM s GROUP BY point, season")
def seasonal_ensemble(spark, sf_dir):
    past = view(spark, sf_dir, "ensemble").where("experiment = 'past'").withColumn("season", C.season(F.col("mon")))
    return rounded(C.ensemble_median(past, "model", ["point", "season"], "yr", "days", "days"))


@query(ENSEMBLE + ", s AS (SELECT model, point, experiment, count_if(days > 10 AND days > 30) / nullif(count_if(days > 10), 0) AS f FROM ensemble GROUP BY ALL), d AS (SELECT p.point, f.f - p.f AS d FROM s p JOIN s f USING (model, point) WHERE p.experiment = 'past' AND f.experiment = 'future') SELECT point, round(median(d), 6) AS change, greatest(count_if(d > 0), count_if(d < 0))::BIGINT AS same_sign FROM d GROUP BY point")
def ensemble_fraction_change(spark, sf_dir):
    return rounded(C.ensemble_share_change(view(spark, sf_dir, "ensemble"), "model", "experiment", "point", F.col("days") > 10, F.col("days") > 30))


@query("SELECT l_orderkey % 100 AS y, l_partkey % 100 AS x, max(coalesce(l_quantity, 0)) AS column_max FROM lineitem GROUP BY 1, 2")
def column_max(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("y"), (F.col("l_partkey") % 100).alias("x")).agg(F.max(F.coalesce("l_quantity", F.lit(0.0))).alias("column_max"))


_CELLS = "WITH cells AS (SELECT l_suppkey % 10 AS scan, l_partkey % 40 AS label, l_orderkey, l_linenumber, l_linenumber AS z, l_quantity AS v FROM lineitem)"


@query(_CELLS + ", g AS (SELECT scan, label FROM cells GROUP BY scan, label HAVING count(*) >= 12 AND count_if(v > 40) >= 3 AND max(z) - min(z) >= 5), n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY label) AS object FROM g) SELECT scan, object::INTEGER AS object, count(*)::BIGINT AS cells, max(v) AS v_max FROM cells JOIN n USING (scan, label) GROUP BY scan, object")
def filter_small_objects(spark, sf_dir):
    cells = view(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("scan"), (F.col("l_partkey") % 40).alias("label"), F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("v"))
    return C.filter_small_objects(cells, ["scan"], "label", F.col("v") > 40, 12, 3, 5).groupBy("scan", "object").agg(F.count("*").alias("cells"), F.max("v").alias("v_max"))


@query(_CELLS + " SELECT scan, label, z::INTEGER AS z, max(v) AS v_max, round(quantile_cont(abs(v), 0.995), 6) AS v_high FROM cells GROUP BY scan, label, z")
def object_height_profile(spark, sf_dir):
    """Of each object and height, the maximum and the 99.5th percentile of the size."""
    return _object_profile(spark, sf_dir, ["scan", "label", "z"], "true")


@query(_CELLS + " SELECT scan, label, max(v) AS v_max, round(quantile_cont(abs(v), 0.995), 6) AS v_high FROM cells WHERE z BETWEEN 2 AND 6 GROUP BY scan, label")
def object_layer_profile(spark, sf_dir):
    """The same over the layer from 2 to 6."""
    return _object_profile(spark, sf_dir, ["scan", "label"], "z between 2 and 6")


def _object_profile(spark, sf_dir, keys, layer):
    cells = view(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("scan"), (F.col("l_partkey") % 40).alias("label"), F.col("l_linenumber").cast("int").alias("z"), F.col("l_quantity").alias("v")).where(layer)
    high = exact_quantiles(cells, keys, F.abs("v"), {"v_high": 0.995})
    return rounded(cells.groupBy(*keys).agg(F.max("v").alias("v_max")).join(high, keys))


@query(SKILL + " SELECT row_id, predictor, x FROM (SELECT row_id, l_quantity, l_discount, l_tax FROM skill) UNPIVOT (x FOR predictor IN (l_quantity, l_discount, l_tax))")
def melt(spark, sf_dir):
    return view(spark, sf_dir, "skill").unpivot("row_id", ["l_quantity", "l_discount", "l_tax"], "predictor", "x")


@query(SKILL + ", p AS (SELECT cluster, mon, 1 / (1 + exp(-(-3.0 + 0.05 * l_quantity + 4.0 * l_discount))) AS p FROM skill) SELECT cluster, round(sum(p) / 365, 6) AS expected, count_if(p > 0.3)::BIGINT AS over FROM p GROUP BY cluster")
def daily_exceedance_expectation(spark, sf_dir):
    p = X.logit_score({"const": -3.0, "l_quantity": 0.05, "l_discount": 4.0})
    return rounded(view(spark, sf_dir, "skill").withColumn("p", p).groupBy("cluster").agg((F.sum("p") / 365).alias("expected"), F.count_if(F.col("p") > 0.3).alias("over")))


@query(SKILL + " SELECT mon::INTEGER AS mon, count(*)::BIGINT AS n FROM skill WHERE l_extendedprice > 30000 GROUP BY mon")
def monthly_threshold_counts(spark, sf_dir):
    return view(spark, sf_dir, "skill").where("l_extendedprice > 30000").groupBy(F.col("mon").cast("int").alias("mon")).agg(F.count("*").alias("n"))


@query(TRACKS + " SELECT uid, scan, round(speed * sin(radians(angle)), 6) + 0.0 AS u, round(speed * cos(radians(angle)), 6) + 0.0 AS v, strftime(time, '%Y%m%d%H%M%S') || '/' || uid AS group_id, lpad(CAST(uid AS VARCHAR), 6, '0') AS padded FROM tracks WHERE speed_rnge < 4 AND speed < 30")
def reliable_motion(spark, sf_dir):
    u, v = X.storm_motion_uv(F.col("speed"), F.col("angle"))
    fit = view(spark, sf_dir, "tracks").where("speed_rnge < 4 AND speed < 30")
    return rounded(fit.select("uid", "scan", u.alias("u"), v.alias("v"), X.group_id(F.col("time"), F.col("uid")).alias("group_id"), F.lpad(F.col("uid").cast("string"), 6, "0").alias("padded")))


@query(TRACKS + " SELECT uid, median(azi_shear) AS shear, max(max_alt) AS top, min(speed) AS slowest, count(*)::BIGINT AS scans FROM tracks GROUP BY uid")
def storm_lifetime_mixed(spark, sf_dir):
    return view(spark, sf_dir, "tracks").groupBy("uid").agg(F.median("azi_shear").alias("shear"), F.max("max_alt").alias("top"), F.min("speed").alias("slowest"), F.count("*").alias("scans"))
