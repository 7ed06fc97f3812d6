"""From storm masks, stations and gusts to severe storm events: the whole chain as one function."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeworks.functions.exprs import micros, quotient, scw_flag
from galeworks.operators.chains import stored
from galeworks.operators.events import decluster_forward
from galeworks.operators.spatial import best_storm, few, storm_within_asked
from galeworks.operators.temporal import asof_join, rolling_mean


@dataclass(frozen=True)
class ChainRules:
    """Radii in cells around a mask and the one that counts as near; for how long (seconds) a scan holds; the frames of the mean gust (around), with
    the least values in them; what makes a gust severe; and within which time one event of a radar remains."""

    radii: Sequence[int] = (0, 10, 20)
    near: int = 10
    holds: float = 600
    around: float = 7200
    least: int = 60
    gust: float = 25.0
    ratio: float = 2.0
    apart: float = 3600


def _gusts_at_scans(storms: DataFrame, points: DataFrame, gusts: DataFrame, rules: ChainRules) -> tuple[DataFrame, DataFrame]:
    """Gusts of quality Y with their scan, its strongest storm (__uid) and the places of their station on the radar's grid (__place); and the storms without
    those of scans that no gust has, where few scans, by a count, are left."""
    strongest = F.max_by("uid", F.struct("field_max", -F.col("uid"))).alias("__uid")
    scans = stored(storms.groupBy("rid", "scan").agg(F.min("scan_time").alias("scan_time"), strongest), "scans")  # read for ranges and rows
    places = points.groupBy("rid", "stn_id").agg(F.array_sort(F.collect_set(F.struct("pi", "pj"))).alias("__place"))
    own = gusts.where("q = 'Y'").join(places, "stn_id")
    at = stored(asof_join(own, scans, ["rid"], "dt_utc", "scan_time", ["scan", "__uid"], rules.holds, clip_to_last=True), "gusts")
    asked = few(at.select("rid", "scan").distinct())
    return at, storms if asked is None else storms.join(asked, ["rid", "scan"], "left_semi")


def storms_of_gusts(masks: DataFrame, storms: DataFrame, points: DataFrame, gusts: DataFrame, rules: ChainRules) -> DataFrame:
    """gusts (stn_id, dt_utc, gust, event_id, q) of quality Y with rid, scan, scan_time and, for each radius r, uid<r>, in<r>, and dist<r>.

    masks (rid, scan, uid, i, j), storms (rid, scan, scan_time, uid, field_max: one row a storm and scan), points (rid, stn_id, pi, pj: a station on its
    radar's grid). A gust takes the latest scan of its station's radar that is `holds` old at most, and none after the radar's last scan. Of
    that scan's storms the one inside the radius counts, then the strongest; where none is inside, the scan's strongest with in<r> = 0 and no distance.
    Scans meet gusts first, once; storms then meet the places that a gust asks for in their own scan, and stations take what their place has. So no table of
    all scans and stations is made, and none of all storms and the stations near them.
    """
    return _storms_inside(masks, *_gusts_at_scans(storms, points, gusts, rules), rules)


def _storms_inside(masks: DataFrame, at: DataFrame, storms: DataFrame, rules: ChainRules) -> DataFrame:
    asked = at.select("rid", "scan", "__place").distinct().select("*", F.explode("__place").alias("__p")).select("rid", "scan", "__place", "__p.pi", "__p.pj")
    near = storm_within_asked(masks, asked, rules.radii, ("rid", "scan", "uid"), ("rid", "scan"), "__place").join(storms.select("rid", "scan", "uid", "field_max"), ["rid", "scan", "uid"])
    best = best_storm(near, ["rid", "scan", "__place"], {str(r): F.col(f"in{r}") == 1 for r in rules.radii}, "field_max", "uid", ["near"])
    out = at.join(best, ["rid", "scan", "__place"], "left")
    for r in rules.radii:
        inside = F.coalesce(F.col(f"in{r}"), F.lit(0)) == 1
        out = out.withColumns({f"uid{r}": F.when(inside, F.col(f"uid{r}")).otherwise(F.col("__uid")), f"in{r}": inside.cast("int"), f"dist{r}": F.when(inside, F.col(f"near{r}"))})
    return out.drop("__uid", "__place", *[f"near{r}" for r in rules.radii])


def severe_storm_events(masks: DataFrame, storms: DataFrame, points: DataFrame, gusts: DataFrame, environment: DataFrame, rules: ChainRules | None = None, stats: Mapping[str, str] | None = None) -> DataFrame:
    """The severe gusts of each radar that remain, with their storm, its statistics and their environment.

    Gusts get their storm (storms_of_gusts); the near storm's columns of `stats` (names in storms: names in the result) and the environment of the
    station's hour (stn_id, hour, further columns) join on; gusts without either go. A gust is severe where it reaches `gust`, stands
    `ratio` above the mean gust around it, and a storm is near; of a radar's severe gusts within `apart` the strongest remains.
    """
    rules, stats = rules or ChainRules(), stats or {}
    at, storms = _gusts_at_scans(storms, points, gusts, rules)
    gusty = _storms_inside(masks, at, storms, rules)
    of_storm = storms.select("rid", "scan", F.col("uid").alias(f"uid{rules.near}"), *[F.col(c).alias(n) for c, n in stats.items()])
    merged = gusty.join(of_storm, ["rid", "scan", f"uid{rules.near}"]).withColumn("hour", F.date_trunc("hour", "dt_utc").cast("timestamp_ntz")).join(environment, ["stn_id", "hour"])
    meant = rolling_mean(merged, ["stn_id"], "dt_utc", "gust", rules.around, rules.around, rules.least, "rolling").withColumn("ratio", quotient(F.col("gust"), F.col("rolling")))
    severe = stored(meant.where(scw_flag(F.col("gust"), F.col("ratio"), F.col(f"in{rules.near}"), rules.gust, rules.ratio)), "severe")  # read twice
    kept = decluster_forward(severe, ["rid"], "dt_utc", "gust", "event_id", rules.apart).select("event_id")
    return severe.join(kept, "event_id")
