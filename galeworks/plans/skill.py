"""Skill of predictors at telling events from non-events."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeworks.operators import climate as C
from galeworks.operators import resampling as B
from galeworks.operators import skill as K
from galeworks.operators.ordered import exact_quantiles
from galeworks.plans.registry import query
from galeworks.plans.views import ctes, rounded, view

_LONG = ctes("skill") + ", tall AS (SELECT row_id, scw, cluster, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS predictor, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM skill)"
_AUC = "by_value AS (SELECT cluster, predictor, x, sum(scw) AS p, sum(1 - scw) AS n FROM tall GROUP BY ALL), u AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY cluster, predictor ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS v FROM by_value)"


def tall(spark, sf_dir):
    """Predictors as rows."""
    return view(spark, sf_dir, "skill").unpivot(["row_id", "scw", "cluster"], ["l_quantity", "l_extendedprice", "l_discount"], "predictor", "x")


@query(ctes("skill") + """, tall AS (SELECT scw, in10km, cluster, mon % 6 AS class, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS predictor, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM skill),
s AS (SELECT scw, in10km, predictor, x, unnest(['all', 'cluster ' || cluster, 'class ' || class]) AS stratum FROM tall), t AS (SELECT scw, predictor, x, stratum, unnest(CASE WHEN scw = 1 OR in10km = 1 THEN ['all', 'storms'] ELSE ['all'] END) AS null_set FROM s),
b AS (SELECT stratum, null_set, predictor, x, sum(scw) AS p, sum(1 - scw) AS n FROM t GROUP BY ALL),
u AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY stratum, null_set, predictor ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS v FROM b),
a AS (SELECT stratum, null_set, predictor, sum(v) / (sum(p) * sum(n)) AS auc, sum(p)::BIGINT AS events, sum(x * p) / sum(p) AS me, sum(x * n) / sum(n) AS mn FROM u GROUP BY ALL)
SELECT stratum, null_set, predictor, round(CASE WHEN me < mn THEN 1 - auc ELSE auc END, 6) AS auc, events FROM a""")
def auc_many(spark, sf_dir):
    """AUC of each predictor over all rows, each cluster and each class, against all non-events and those with a storm near; predictors
    that are lower in events are turned round. Equal values meet before they are copied to their strata."""
    s = view(spark, sf_dir, "skill")
    strata = [F.lit("all"), F.concat(F.lit("cluster "), F.col("cluster").cast("string")), F.concat(F.lit("class "), (F.col("mon") % 6).cast("string"))]
    found = K.auc_many(s, ["l_quantity", "l_extendedprice", "l_discount"], "scw", strata, {"all": F.lit(True), "storms": F.col("in10km") == 1})
    return rounded(found.select("stratum", "null_set", "predictor", "auc", "events"))


@query(ctes("skill") + ", c AS (SELECT cluster, count_if(scw = 1 AND l_quantity > 25) AS hits, count_if(scw = 1 AND l_quantity <= 25) AS misses, count_if(scw = 0 AND l_quantity > 25) AS false_alarms, count_if(scw = 0 AND l_quantity <= 25) AS correct_nulls FROM skill GROUP BY cluster) SELECT cluster, hits::BIGINT AS hits, misses::BIGINT AS misses, round(hits / (hits + misses), 6) AS pod, round(false_alarms / (hits + false_alarms), 6) AS far, round((hits + false_alarms) / (hits + misses), 6) AS bias, round(hits / (hits + misses) - false_alarms / (false_alarms + correct_nulls), 6) AS tss, round(hits / (hits + misses + false_alarms), 6) AS csi, round(CASE WHEN hits / (hits + misses) > 0.4 THEN 2 * (hits * correct_nulls - misses * false_alarms) / ((hits + misses) * (misses + correct_nulls) + (hits + false_alarms) * (false_alarms + correct_nulls)) ELSE 0 END, 6) AS hss FROM c")
def contingency_scores(spark, sf_dir):
    """All scores of one threshold; HSS counts from a hit rate of 0.4 on, so that it does here."""
    return rounded(K.scores(K.contingency(view(spark, sf_dir, "skill"), ["cluster"], "scw", F.col("l_quantity") > 25), 0.4).select("cluster", "hits", "misses", "pod", "far", "bias", "tss", "csi", "hss"))


@query(ctes("skill") + ", t AS (SELECT unnest(range(50)) AS step) SELECT cluster, step::INTEGER AS step, count_if(scw = 1 AND l_quantity > step)::BIGINT AS hits, count_if(scw = 0 AND l_quantity > step)::BIGINT AS false_alarms FROM skill JOIN t ON true GROUP BY cluster, step")
def threshold_sweep(spark, sf_dir):
    return K.threshold_sweep(view(spark, sf_dir, "skill"), ["cluster"], "scw", "l_quantity", 50, 49.0).select("cluster", "step", "hits", "false_alarms")


@query(ctes("skill") + """, m AS (SELECT cluster, max(l_extendedprice) AS top FROM skill WHERE scw = 1 GROUP BY cluster), t AS (SELECT unnest(range(100)) AS step),
c AS (SELECT cluster, step, any_value(top) AS top, count_if(scw = 1 AND l_extendedprice * 99 > step * top) AS h, count_if(scw = 1 AND l_extendedprice * 99 <= step * top) AS m, count_if(scw = 0 AND l_extendedprice * 99 > step * top) AS f, count_if(scw = 0 AND l_extendedprice * 99 <= step * top) AS c
 FROM skill JOIN m USING (cluster) JOIN t ON true GROUP BY cluster, step),
s AS (SELECT cluster, step, top, unnest(['tss', 'csi', 'hss']) AS score, unnest([h / (h + m) - f / (f + c), h / (h + m + f), CASE WHEN h / (h + m) > 0.66 THEN 2 * (h * c - f * m) / ((h + m) * (m + c) + (h + f) * (f + c)) ELSE 0 END]) AS v FROM c),
b AS (SELECT cluster, score, max(round(v, 10)) AS best FROM s GROUP BY ALL)
SELECT cluster, score, round(best, 6) AS best, min(step)::BIGINT AS step, round(min(step) * any_value(top) / 99, 4) AS threshold FROM s JOIN b USING (cluster, score) WHERE round(v, 10) = best GROUP BY cluster, score, best""")
def best_threshold(spark, sf_dir):
    """The best TSS, CSI and HSS over a hundred thresholds up to the events' largest value, and the first threshold that attains each."""
    swept = K.scores(K.threshold_sweep(view(spark, sf_dir, "skill"), ["cluster"], "scw", "l_extendedprice", 100))
    best = K.best_threshold(swept, ["cluster"], ["tss", "csi", "hss"])
    return best.select("cluster", "score", F.round("best", 6).alias("best"), F.col("step").cast("long").alias("step"), F.round("threshold", 4).alias("threshold"))


#: Predictors with few values, whose hundredfold is whole, so that it names a value.
FEW = ["l_quantity", "l_discount", "l_tax"]
_MET = ctes("skill") + f""", tall AS (SELECT scw, unnest([0, cluster + 1]) AS stratum, 0 AS one, l_quantity, l_discount, l_tax FROM skill),
each AS (SELECT scw, stratum, unnest(range({len(FEW)})) AS predictor, unnest([{", ".join(FEW)}]) AS x FROM tall),
met AS (SELECT stratum, predictor, x, CAST(round(x * 100) AS BIGINT) AS spot, sum(scw) AS p, sum(1 - scw) AS n FROM each GROUP BY ALL), """
_HALF = {"dp": ("p", 1.0), "dn": ("n", 0.5)}


def predictors(spark, sf_dir):
    """(scw, stratum, predictor, x): every row under all rows (0) and its cluster (from 1 on), once for each of the FEW predictors, which are numbered."""
    s = view(spark, sf_dir, "skill").select("scw", F.explode(F.array(F.lit(0).cast("long"), (F.col("cluster") + 1).cast("long"))).alias("stratum"), *FEW)
    numbered = F.array(*[F.struct(F.lit(k).cast("long").alias("predictor"), F.col(n).cast("double").alias("x")) for k, n in enumerate(FEW)])
    return s.select("scw", "stratum", F.explode(numbered).alias("v")).select("scw", "stratum", "v.*")


#: What names a value of a predictor in a stratum.
SEEDS = ["stratum", "predictor", "round(x * 100)"]


@query(_MET + B.sql_drawn("met", _HALF, ["stratum", "predictor", "spot"], 1000, "drawn") + """,
u AS (SELECT *, dp * (coalesce(sum(dn) OVER (PARTITION BY stratum, predictor, replicate ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dn / 2) AS v FROM drawn),
a AS (SELECT stratum, predictor, replicate, sum(v) / (sum(dp) * sum(dn)) AS auc, sum(x * dp) / sum(dp) AS me, sum(x * dn) / sum(dn) AS mn FROM u GROUP BY ALL)
SELECT stratum::BIGINT AS stratum, predictor::BIGINT AS predictor, replicate::INTEGER AS replicate, round(CASE WHEN me < mn THEN 1 - auc ELSE auc END, 6) AS auc FROM a""")
def bootstrap_scores(spark, sf_dir):
    """AUC of each predictor over a thousand replicates, for all rows and each cluster, with half as many non-events; turned round where events have the lower mean."""
    found = B.bootstrap_skill(predictors(spark, sf_dir), ["stratum", "predictor"], "scw", "x", SEEDS, 1000, 0.5)
    return rounded(found.select("stratum", "predictor", "replicate", F.col("score").alias("auc")))


@query(_MET + "those AS (SELECT * FROM met WHERE predictor = 0), " + B.sql_drawn("those", _HALF, ["stratum", "predictor", "spot"], 1000, "drawn") + """,
m AS (SELECT stratum, replicate, max(x) FILTER (WHERE dp > 0) AS top, sum(dp) AS ap, sum(dn) AS an FROM drawn GROUP BY ALL), t AS (SELECT unnest(range(100)) AS step),
c AS (SELECT stratum, replicate, step, any_value(step * top / 99) AS threshold, sum(CASE WHEN x > step * top / 99 THEN dp ELSE 0 END) / any_value(ap) - sum(CASE WHEN x > step * top / 99 THEN dn ELSE 0 END) / any_value(an) AS tss FROM drawn JOIN m USING (stratum, replicate) JOIN t ON true GROUP BY ALL),
b AS (SELECT stratum, replicate, max(struct_pack(a := round(tss, 10), b := -step, t := threshold)) AS x FROM c WHERE tss IS NOT NULL GROUP BY ALL)
SELECT stratum::BIGINT AS stratum, replicate::INTEGER AS replicate, round(x.a, 6) AS tss, round(x.t, 6) AS threshold FROM b""")
def bootstrap_thresholds(spark, sf_dir):
    """The best TSS and its threshold over a thousand replicates, for all rows and each cluster, with half as many non-events."""
    found = B.bootstrap_skill(predictors(spark, sf_dir).where("predictor = 0"), ["stratum", "predictor"], "scw", "x", SEEDS, 1000, 0.5, "tss")
    return rounded(found.select("stratum", "replicate", F.col("score").alias("tss"), "threshold"))


_KS = "sum(a) OVER w / sum(a) OVER e - sum(c) OVER w / sum(c) OVER e"
_P = "CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z))), 0.0), 1.0) END"


@query(ctes("skill") + f""", r AS (SELECT 'events ' || cluster AS pair, l_quantity AS x, scw AS a, 1 - scw AS c FROM skill UNION ALL
 SELECT 'clusters ' || a || ' ' || b, l_quantity, CASE WHEN cluster = a THEN 1 ELSE 0 END, CASE WHEN cluster = b THEN 1 ELSE 0 END FROM skill JOIN (VALUES (0, 1), (0, 2), (1, 2)) AS t(a, b) ON cluster = a OR cluster = b),
v AS (SELECT pair, x, sum(a) AS a, sum(c) AS c FROM r GROUP BY ALL), g AS (SELECT pair, a, c, abs({_KS}) AS d FROM v WINDOW w AS (PARTITION BY pair ORDER BY x), e AS (PARTITION BY pair)),
z AS (SELECT pair, max(d) AS d, max(d) * sqrt(sum(a) * sum(c) / (sum(a) + sum(c))) AS z FROM g GROUP BY pair) SELECT pair, round(d, 6) AS distance, round({_P}, 6) AS p FROM z""")
def ks_two_sample(spark, sf_dir):
    """Events against non-events in each cluster, and each two clusters against each other."""
    s = view(spark, sf_dir, "skill")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    events = s.select(name("events ", F.col("cluster")).alias("pair"), "l_quantity", (F.col("scw") == 1).alias("first"))
    pairs = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))]), lambda p: (p["a"] == F.col("cluster")) | (p["b"] == F.col("cluster")))
    each = s.select("cluster", "l_quantity", F.explode(pairs).alias("p")).select(name("clusters ", F.col("p.a"), " ", F.col("p.b")).alias("pair"), "l_quantity", (F.col("cluster") == F.col("p.a")).alias("first"))
    return rounded(K.ks_two_sample(events.unionByName(each), ["pair"], F.col("first"), "l_quantity"))


@query(ctes("skill") + " SELECT cluster, mon, round(100.0 * count_if(scw = 1) / count(*), 6) AS event_share, round(100.0 * count_if(scw = 1 AND in10km = 1) / count_if(in10km = 1), 6) AS near_share FROM skill GROUP BY GROUPING SETS ((), (cluster), (cluster, mon))")
def event_probability(spark, sf_dir):
    hit, near = F.col("scw") == 1, F.col("in10km") == 1
    return rounded(C.conditional_shares(view(spark, sf_dir, "skill"), [[], ["cluster"], ["cluster", "mon"]], {"event_share": (hit, None), "near_share": (hit, near)}, 100.0))


@query(ctes("skill") + " SELECT cluster, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM skill GROUP BY cluster")
def quantiles_and_fits(spark, sf_dir):
    """Quartiles, correlation and the least-squares line of each cluster."""
    s, x, q = view(spark, sf_dir, "skill"), F.col("l_extendedprice"), F.col("l_quantity")
    quartiles = rounded(exact_quantiles(s, ["cluster"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), 4)
    fits = s.groupBy("cluster").agg(F.round(F.corr(q, x), 6).alias("pearson"), F.round(F.regr_slope(x, q), 4).alias("slope"), F.round(F.regr_intercept(x, q), 3).alias("intercept"), F.round(F.regr_r2(x, q), 6).alias("r2"))
    return quartiles.join(fits, "cluster")


@query(ctes("ensemble") + ", s AS (SELECT model, experiment, point, sum(days) / count(DISTINCT yr) AS d FROM ensemble GROUP BY ALL), c AS (SELECT p.point, p.d AS past, f.d - p.d AS diff FROM s p JOIN s f ON f.model = p.model AND f.point = p.point AND p.experiment = 'past' AND f.experiment = 'future') SELECT point, round(median(diff), 6) AS change, greatest(count_if(diff > 0), count_if(diff < 0))::BIGINT AS same_sign, round(avg(past), 6) AS past_mean, greatest(count_if(diff > 0), count_if(diff < 0)) >= 10 AND avg(past) >= 1 AS agreed FROM c GROUP BY point")
def ensemble_change(spark, sf_dir):
    return rounded(C.ensemble_change(view(spark, sf_dir, "ensemble"), "model", "experiment", ["point"], "yr", "days", 10, 1.0))


@query(ctes("ensemble") + ", m AS (SELECT mon, sum(days) AS d FROM ensemble GROUP BY mon) SELECT a.mon, round(avg(b.d), 6) AS smooth FROM m a JOIN m b ON b.mon IN (a.mon, a.mon % 12 + 1, (a.mon + 10) % 12 + 1) GROUP BY a.mon")
def circular_smooth_3(spark, sf_dir):
    m = view(spark, sf_dir, "ensemble").groupBy("mon").agg(F.sum("days").alias("d"))
    return rounded(C.circular_smooth(m, [], "mon", "d", 12, "smooth"))
