"""Grid stencils and vertical profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeworks.functions import exprs as X
from galeworks.operators import climate as C
from galeworks.operators import grid as G
from galeworks.operators.models import kmeans_assign
from galeworks.plans.registry import query
from galeworks.plans.views import ctes, rounded, view
from galeworks.sources import readers as R

ENV, LEVELS = ctes("env"), ctes("levels")


@query(ENV + " SELECT h, i // 4 AS bi, j // 4 AS bj, round(avg(s06), 10) AS s06, round(avg(lr13), 10) AS lr13 FROM env GROUP BY ALL")
def coarsen(spark, sf_dir):
    return rounded(G.coarsen(view(spark, sf_dir, "env"), ["h"], 4, ["s06", "lr13"]), 10)


def _slope(v, x, keys, order):
    w = f"OVER (PARTITION BY {keys} ORDER BY {order})"
    g = lambda e, k: f"{'lag' if k < 0 else 'lead'}({e}, {abs(k)}) {w}"
    return (
        f"CASE WHEN {g(x, -1)} IS NULL THEN (-3 * {v} + 4 * {g(v, 1)} - {g(v, 2)}) / ({g(x, 2)} - {x}) WHEN {g(x, 1)} IS NULL THEN (3 * {v} - 4 * {g(v, -1)} + {g(v, -2)}) / ({x} - {g(x, -2)})"
        f" ELSE ({g(v, 1)} - {g(v, -1)}) / ({g(x, 1)} - {g(x, -1)}) END"
    )


_X, _Y = "(radians(lon) * 6373.0 * cos(radians(lat)))", "(radians(lat) * 6373.0)"


@query(ENV + f", d AS (SELECT h, i, j, {_slope('s06', _X, 'h, i', 'j')} AS x, {_slope('s06', _Y, 'h, j', 'i')} AS y FROM env) SELECT h, i, j, round(sqrt(x * x + y * y), 6) AS gradient FROM d")
def gradient_magnitude(spark, sf_dir):
    return rounded(G.gradient_magnitude(view(spark, sf_dir, "env"), "h", "s06", "gradient").select("h", "i", "j", "gradient"))


@query(ENV + f""", k AS (SELECT *, {_X} AS x, {_Y} AS y FROM env), d AS (SELECT h, i, j, lat,
 (lead(lr13) OVER a - 2 * lr13 + lag(lr13) OVER a) / pow((lead(x) OVER a - lag(x) OVER a) / 2, 2) + (lead(lr13) OVER b - 2 * lr13 + lag(lr13) OVER b) / pow((lead(y) OVER b - lag(y) OVER b) / 2, 2) AS l
 FROM k WINDOW a AS (PARTITION BY h, i ORDER BY j), b AS (PARTITION BY h, j ORDER BY i)) SELECT h, i, j, round(l / (2 * 7.292e-5 * sin(radians(lat))), 6) AS vorticity FROM d""")
def laplacian_over_f(spark, sf_dir):
    return rounded(G.laplacian_over_f(view(spark, sf_dir, "env"), "h", "lr13", "vorticity").select("h", "i", "j", "vorticity"))


@query(ENV + """, b AS (SELECT least(floor((s06 - 8) * 12 / 52), 11)::BIGINT AS bx, least(floor((umean06 - 2) * 10 / 22), 9)::BIGINT AS "by", count(*) AS n FROM env WHERE s06 BETWEEN 8 AND 60 AND umean06 BETWEEN 2 AND 24 GROUP BY ALL),
 f AS (SELECT x AS bx, y AS "by", coalesce(n, 0) AS n FROM range(12) AS a(x) CROSS JOIN range(10) AS c(y) LEFT JOIN b ON b.bx = x AND b."by" = y),
 k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * e * e)) FROM range(-4, 5) AS q(e)) AS w FROM range(-4, 5) AS p(d)),
 g AS (SELECT t AS bx, f."by", sum(n * w) AS n FROM range(12) AS o(t) CROSS JOIN k JOIN f ON f.bx = CASE WHEN t + d < 0 THEN -(t + d) - 1 WHEN t + d >= 12 THEN 23 - t - d ELSE t + d END GROUP BY ALL),
 r AS (SELECT g.bx, t AS "by", sum(n * w) AS n FROM range(10) AS o(t) CROSS JOIN k JOIN g ON g."by" = CASE WHEN t + d < 0 THEN -(t + d) - 1 WHEN t + d >= 10 THEN 19 - t - d ELSE t + d END GROUP BY ALL)
 SELECT bx, "by", round(n, 6) AS n FROM r""")
def gaussian_smooth(spark, sf_dir):
    from galeworks.operators.climate import bins, hist2d

    h = hist2d(view(spark, sf_dir, "env"), bins(F.col("s06"), 8, 60, 12), bins(F.col("umean06"), 2, 24, 10), 12, 10)
    return rounded(G.gaussian_smooth(h.select("bx", "by", F.col("n").cast("double").alias("n")), {"bx": 12, "by": 10}, "n").select("bx", "by", "n"))


_SURFACE = "surface AS (SELECT profile_id, min(cluster) AS cluster, 0 AS level, 1000.0 - 90 * (profile_id % 4) AS p, 0.0 AS z, 22.0 AS t, 0.0 AS u, 0.0 AS v FROM levels GROUP BY profile_id)"


@query(LEVELS + f", {_SURFACE}, a AS (SELECT profile_id, level, p, t FROM levels JOIN (SELECT profile_id, p AS ps FROM surface) USING (profile_id) WHERE p <= ps UNION ALL SELECT profile_id, level, p, t FROM surface) SELECT profile_id, level::INTEGER AS level, round(p, 6) AS p, round(t, 6) AS t FROM a")
def surface_prepend(spark, sf_dir):
    levels = view(spark, sf_dir, "levels").select("profile_id", F.col("level").cast("int").alias("level"), "p", "t")
    surface = levels.groupBy("profile_id").agg(F.lit(0).alias("level"), (1000.0 - 90 * (F.col("profile_id") % 4)).cast("double").alias("p"), F.lit(22.0).alias("t"))
    return rounded(G.surface_prepend(levels, surface, "profile_id", "p"))


HEIGHTS = [300, 600, 900, 1200, 1500]
_BY_Z = """n AS (SELECT *, lead(z) OVER w AS z2, lead(t) OVER w AS t2, lead(u) OVER w AS u2, lead(p) OVER w AS p2 FROM levels WINDOW w AS (PARTITION BY profile_id ORDER BY z)),
 fx AS (SELECT profile_id, g AS target, t + (g - z) / coalesce(z2 - z, 1) * coalesce(t2 - t, 0) AS t, u + (g - z) / coalesce(z2 - z, 1) * coalesce(u2 - u, 0) AS u, p + (g - z) / coalesce(z2 - z, 1) * coalesce(p2 - p, 0) AS p
 FROM n JOIN (SELECT unnest([300.0, 600.0, 900.0, 1200.0, 1500.0])::DOUBLE AS g) ON g = z OR (g > z AND g < z2))"""
_INTERP = LEVELS + ", " + _BY_Z + ", every AS (SELECT profile_id, unnest([300.0, 600.0, 900.0, 1200.0, 1500.0])::DOUBLE AS target FROM (SELECT DISTINCT profile_id FROM levels))"


@query(_INTERP + " SELECT profile_id, target, round(t, 6) AS t, round(u, 6) AS u FROM every LEFT JOIN fx USING (profile_id, target)")
def interp_profile(spark, sf_dir):
    """Every profile at fixed heights; null outside."""
    return rounded(G.interp_profile(view(spark, sf_dir, "levels"), ["profile_id"], "z", ["t", "u"], HEIGHTS))


_OWN = """own AS (SELECT profile_id, min(cluster) OVER w AS cluster, z, p, t, u * cos(atan2(avg(v) OVER w, avg(u) OVER w)) + v * sin(atan2(avg(v) OVER w, avg(u) OVER w)) AS along, v * cos(atan2(avg(v) OVER w, avg(u) OVER w)) - u * sin(atan2(avg(v) OVER w, avg(u) OVER w)) AS across
 FROM levels WINDOW w AS (PARTITION BY profile_id))"""


@query(LEVELS + f""", {_OWN}, {_BY_Z}, c AS (SELECT DISTINCT profile_id, cluster FROM own), m AS (SELECT cluster, target, avg(p) AS p FROM fx JOIN c USING (profile_id) GROUP BY cluster, target),
q AS (SELECT *, lead(p) OVER w AS p2, lead(t) OVER w AS t2, lead(along) OVER w AS l2, lead(across) OVER w AS c2 FROM own WINDOW w AS (PARTITION BY profile_id ORDER BY p)),
a AS (SELECT q.cluster, m.target, m.p, t + (m.p - q.p) / coalesce(p2 - q.p, 1) * coalesce(t2 - t, 0) AS t, along + (m.p - q.p) / coalesce(p2 - q.p, 1) * coalesce(l2 - along, 0) AS along, across + (m.p - q.p) / coalesce(p2 - q.p, 1) * coalesce(c2 - across, 0) AS across
 FROM q JOIN m ON m.cluster = q.cluster AND (m.p = q.p OR (m.p > q.p AND m.p < p2)))
SELECT cluster, target, round(p, 6) AS p, round(avg(t), 5) AS t, round(avg(along), 5) AS along, round(avg(across), 5) + 0.0 AS across FROM a GROUP BY cluster, target, p""")
def composite_profile(spark, sf_dir):
    """Mean profiles of each cluster: winds along and across each profile's mean wind, all taken at the cluster's mean pressure of a height."""
    levels = view(spark, sf_dir, "levels")
    mean = {n: F.expr(f"{f}({c}) over (partition by profile_id)") for n, f, c in (("cluster", "min", "cluster"), ("mu", "avg", "u"), ("mv", "avg", "v"))}
    own = levels.withColumns(mean)
    along, across = X.rotate_wind(*map(F.col, ("u", "v", "mu", "mv")))
    found = G.composite_profile(own.withColumns({"along": along, "across": across}), ["profile_id"], "cluster", "z", "p", ["t", "along", "across"], HEIGHTS)
    return found.select("cluster", "target", F.round("p", 6).alias("p"), F.round("t", 5).alias("t"), F.round("along", 5).alias("along"), (F.round("across", 5) + 0.0).alias("across"))


@query(LEVELS + ", n AS (SELECT profile_id, u, v, p - lead(p) OVER w AS d, (u + lead(u) OVER w) / 2 AS um, (v + lead(v) OVER w) / 2 AS vm FROM levels WINDOW w AS (PARTITION BY profile_id ORDER BY p DESC)) SELECT profile_id, round(CASE WHEN count(*) = 1 THEN max(u) ELSE sum(um * d) / sum(d) END, 6) AS u, round(CASE WHEN count(*) = 1 THEN max(v) ELSE sum(vm * d) / sum(d) END, 6) AS v, round(avg(u), 6) AS u_plain, round(avg(v), 6) AS v_plain FROM n GROUP BY profile_id")
def layer_mean(spark, sf_dir):
    """Layer means weighted by thickness, and plain ones."""
    levels = view(spark, sf_dir, "levels")
    plain = G.layer_mean(levels, ["profile_id"], "p", ["u", "v"], weighted=False).withColumnsRenamed({"u": "u_plain", "v": "v_plain"})
    return rounded(G.layer_mean(levels, ["profile_id"], "p", ["u", "v"]).join(plain, "profile_id"))


_MOTION = LEVELS + """, m AS (SELECT profile_id, avg(u) AS mu, avg(v) AS mv, arg_max(u, z) - arg_min(u, z) AS su, arg_max(v, z) - arg_min(v, z) AS sv FROM levels GROUP BY profile_id),
 o AS (SELECT profile_id, mu - CASE WHEN su * su + sv * sv > 0 THEN 7.5 / sqrt(su * su + sv * sv) ELSE 0 END * sv AS motion_u, mv + CASE WHEN su * su + sv * sv > 0 THEN 7.5 / sqrt(su * su + sv * sv) ELSE 0 END * su AS motion_v FROM m)"""


@query(_MOTION + " SELECT profile_id, round(motion_u, 5) AS motion_u, round(motion_v, 5) AS motion_v FROM o")
def bunkers_motion(spark, sf_dir):
    return rounded(G.bunkers_motion(view(spark, sf_dir, "levels"), ["profile_id"], "z"), 5)


@query(_MOTION + ", r AS (SELECT profile_id, z, u - motion_u AS x, v - motion_v AS y FROM levels JOIN o USING (profile_id) WHERE z <= 1000), s AS (SELECT profile_id, lead(x) OVER w * y - x * lead(y) OVER w AS a FROM r WINDOW w AS (PARTITION BY profile_id ORDER BY z)) SELECT profile_id, round(abs(sum(a)), 4) AS srh FROM s GROUP BY profile_id")
def storm_relative_helicity(spark, sf_dir):
    levels = view(spark, sf_dir, "levels")
    return rounded(G.storm_relative_helicity(levels, G.bunkers_motion(levels, ["profile_id"], "z"), ["profile_id"], "z", 1000), 4)


_ROT = LEVELS + ", m AS (SELECT *, atan2(avg(v) OVER w, avg(u) OVER w) AS a FROM levels WINDOW w AS (PARTITION BY profile_id)) SELECT profile_id, level::INTEGER AS level, round(u * cos(a) + v * sin(a), 6) + 0.0 AS along, round(v * cos(a) - u * sin(a), 6) + 0.0 AS across FROM m"


@query(_ROT)
def rotate_wind(spark, sf_dir):
    m = view(spark, sf_dir, "levels").withColumns({"mu": F.expr("avg(u) over (partition by profile_id)"), "mv": F.expr("avg(v) over (partition by profile_id)")})
    along, across = X.rotate_wind(*map(F.col, ("u", "v", "mu", "mv")))
    return rounded(m.select("profile_id", F.col("level").cast("int").alias("level"), along.alias("along"), across.alias("across")))


# Training bounds and centres of the three environments in the stand-in's scale.
BOUNDS = {"s06": (8.0, 60.0), "qmean01": (4.0, 16.0), "lr13": (5.0, 10.0), "umean06": (2.0, 24.0)}
CENTRES = [[0.45, 0.3, 0.2, 0.4], [0.5, 0.5, 0.5, 0.45], [0.55, 0.4, 0.3, 0.6]]
_S = ", ".join(f"({n} - {a}) / {b - a} AS {n}" for n, (a, b) in BOUNDS.items())
_D = ", ".join("(" + " + ".join(f"pow({n} - {x}, 2)" for n, x in zip(BOUNDS, c, strict=True)) + f") AS d{k}" for k, c in enumerate(CENTRES))
_ASSIGN = ENV + f", s AS (SELECT h, i, j, {_S} FROM env), d AS (SELECT *, {_D} FROM s), a AS (SELECT *, CASE least(d0, d1, d2) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS cluster FROM d)"


def scaled(spark, sf_dir):
    return view(spark, sf_dir, "env").withColumns({n: X.minmax_scale(F.col(n), F.lit(a), F.lit(b)) for n, (a, b) in BOUNDS.items()})


@query(_ASSIGN + " SELECT h, i, j, CASE WHEN (i + j + h) % 9 <> 0 THEN cluster END::BIGINT AS cluster FROM a")
def kmeans_assign_grid(spark, sf_dir):
    """The cluster of each grid point; a point that lacks a field has none."""
    holed = scaled(spark, sf_dir).withColumn("lr13", F.when((F.col("i") + F.col("j") + F.col("h")) % 9 != 0, F.col("lr13")))
    return holed.select("h", "i", "j", kmeans_assign(list(BOUNDS), CENTRES).cast("long").alias("cluster"))


# The grid of the full job: a field a day and place, from the table's rows of that day.
_DAILY = """WITH d AS (SELECT l_partkey % 16 AS i, l_orderkey % 18 AS j, l_shipdate AS day, avg(l_quantity) AS s06, 100 * avg(l_discount) AS qmean01, 5 + 50 * avg(l_tax) AS lr13, avg(l_extendedprice) / 5000 AS umean06
 FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 1996 GROUP BY ALL)"""
_LOGIT = " + ".join(f"{X.BDSD[t]} * {c}" for t, c in X.BDSD_STAND_IN.items())


@query(_DAILY + f""", s AS (SELECT i, j, day, 1 / (1 + exp(-({_LOGIT} + {X.BDSD["const"]}))) AS score, {_S} FROM d), k AS (SELECT *, {_D} FROM s), a AS (SELECT *, CASE least(d0, d1, d2) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS cluster FROM k)
SELECT i, j, year(day)::INTEGER AS yr, month(day)::INTEGER AS mon, count(DISTINCT day) FILTER (WHERE cluster = 0)::BIGINT AS c0, count(DISTINCT day) FILTER (WHERE cluster = 1)::BIGINT AS c1, count(DISTINCT day) FILTER (WHERE cluster = 2)::BIGINT AS c2, count(DISTINCT day) FILTER (WHERE score > 0.5)::BIGINT AS severe FROM a GROUP BY ALL""")
def gridded_cluster_climatology(spark, sf_dir):
    """The whole gridded job: a time slice of the grid, the logistic score and scaled fields of each point, its cluster, and the days of
    each month on which a point lies in each cluster or scores above a half."""
    grid = view(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 16).alias("i"), (F.col("l_orderkey") % 18).alias("j"), F.col("l_shipdate").alias("time")).agg(
        F.avg("l_quantity").alias("s06"), (100 * F.avg("l_discount")).alias("qmean01"), (5 + 50 * F.avg("l_tax")).alias("lr13"), (F.avg("l_extendedprice") / 5000).alias("umean06")
    )
    cut = R.grid_slice(grid, ["i", "j"], "time", list(BOUNDS), F.make_date(F.lit(1995), F.lit(1), F.lit(1)), F.make_date(F.lit(1996), F.lit(12), F.lit(31)))
    scored = cut.withColumn("score", X.logit_score({**{c: X.BDSD[t] for t, c in X.BDSD_STAND_IN.items()}, "const": X.BDSD["const"]}))
    fields = scored.withColumns({n: X.minmax_scale(F.col(n), F.lit(a), F.lit(b)) for n, (a, b) in BOUNDS.items()}).withColumn("cluster", kmeans_assign(list(BOUNDS), CENTRES))
    flags = {f"c{k}": F.col("cluster") == k for k in range(3)} | {"severe": F.col("score") > 0.5}
    return C.days_per_month(fields, ["i", "j"], F.col("time"), flags)


_MODELS = _DAILY.replace("SELECT l_partkey", "SELECT l_suppkey % 12 AS model, CASE WHEN year(l_shipdate) < 1995 THEN 'past' ELSE 'future' END AS period, l_partkey").replace("WHERE year(l_shipdate) BETWEEN 1995 AND 1996 ", "")


@query(_MODELS + f""", s AS (SELECT model, period, i, j, day, 1 / (1 + exp(-({_LOGIT} + {X.BDSD["const"]}))) AS score, {_S} FROM d), k AS (SELECT *, {_D} FROM s), a AS (SELECT *, CASE least(d0, d1, d2) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS cluster FROM k)
SELECT model, period, i, j, year(day)::INTEGER AS yr, month(day)::INTEGER AS mon, """ + ", ".join(f"count(DISTINCT day) FILTER (WHERE {c})::BIGINT AS {n}" for n, c in {**{f"c{k}": f"cluster = {k}" for k in range(3)}, "severe": "score > 0.5", **{f"severe{k}": f"score > 0.5 AND cluster = {k}" for k in range(3)}}.items()) + " FROM a GROUP BY ALL")
def ensemble_cluster_climatology(spark, sf_dir):
    """The gridded job for twelve models and two periods, over all years of the table."""
    period = F.when(F.year("l_shipdate") < 1995, "past").otherwise("future").alias("period")
    grid = view(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("model"), period, (F.col("l_partkey") % 16).alias("i"), (F.col("l_orderkey") % 18).alias("j"), F.col("l_shipdate").alias("time")).agg(
        F.avg("l_quantity").alias("s06"), (100 * F.avg("l_discount")).alias("qmean01"), (5 + 50 * F.avg("l_tax")).alias("lr13"), (F.avg("l_extendedprice") / 5000).alias("umean06")
    )
    score = X.logit_score({**{c: X.BDSD[t] for t, c in X.BDSD_STAND_IN.items()}, "const": X.BDSD["const"]})
    fields = grid.withColumn("score", score).withColumns({n: X.minmax_scale(F.col(n), F.lit(a), F.lit(b)) for n, (a, b) in BOUNDS.items()})
    return C.cluster_climatology(fields, ["model", "period", "i", "j"], "time", kmeans_assign(list(BOUNDS), CENTRES), 3, F.col("score"), 0.5)


_SEVEN = {"ebwd": "s06", "Umean800_600": "umean06", "lr13": "lr13", "rhmin13": "50 * lsm", "srhe_left": "-lat", "q_melting": "qmean01", "eff_lcl": "10 * lon"}


@query(ENV + " SELECT h, i, j, round(1 / (1 + exp(-(" + " + ".join(f"{X.BDSD[t]} * ({c})" for t, c in _SEVEN.items()) + f" + {X.BDSD['const']}))), 6) AS score FROM env")
def logit_score_bdsd(spark, sf_dir):
    """The fixed diagnostic of seven terms, with the stand-in's fields in their place."""
    terms = view(spark, sf_dir, "env").withColumns({t: F.expr(f"double({c})") for t, c in _SEVEN.items() if t not in ("lr13",)})
    return rounded(terms.select("h", "i", "j", X.logit_score(X.BDSD).alias("score")))


@query(LEVELS + " SELECT profile_id, level::INTEGER AS level, round((t + 273.15) * pow(1000.0 / p, 0.2854), 6) AS theta, round(243.04 * (ln(rh / 100) + 17.625 * t / (243.04 + t)) / (17.625 - (ln(rh / 100) + 17.625 * t / (243.04 + t))), 6) AS dewpoint FROM (SELECT *, 40.0 + u AS rh FROM levels)")
def thermodynamics(spark, sf_dir):
    """Potential temperature and dewpoint of each level."""
    out = view(spark, sf_dir, "levels").withColumn("rh", 40.0 + F.col("u"))
    return rounded(out.select("profile_id", F.col("level").cast("int").alias("level"), X.potential_temp(F.col("t") + 273.15, F.col("p")).alias("theta"), X.dewpoint_from_rh(F.col("t"), F.col("rh")).alias("dewpoint")))
