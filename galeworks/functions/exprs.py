"""Scalar expressions: distances, calendar, ratios, storm classes, logistic scores, thermodynamics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6373.0

# The logistic diagnostic of severe-wind environments.
BDSD = {"ebwd": 6.1e-02, "Umean800_600": 1.5e-01, "lr13": 9.4e-01, "rhmin13": 3.9e-02, "srhe_left": 1.7e-02, "q_melting": 3.8e-01, "eff_lcl": 4.7e-04, "const": -1.3e01}

# Which terms of it the stand-in grid has fields for.
BDSD_STAND_IN = {"ebwd": "s06", "Umean800_600": "umean06", "lr13": "lr13", "q_melting": "qmean01"}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of EARTH_KM."""
    lat1, lon1, lat2, lon2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def group_id(time: Column, uid: Column) -> Column:
    return F.concat(F.date_format(time, "yyyyMMddHHmmss"), F.lit("/"), uid.cast("string"))


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def to_minute(time: Column) -> Column:
    """Nearest minute, ties to the even one."""
    return F.timestamp_seconds(F.rint(micros(time) / 60_000_000.0).cast("long") * 60).cast("timestamp_ntz")


def floor_to(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time)


def local_time(time: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(time, zone)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.when(b != 0, a / b)


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles are divided: over zero it is an infinity, or NaN, and no error."""
    return F.when(b == 0, a.cast("double") * float("inf")).otherwise(a / b)


def storm_motion_uv(speed: Column, angle: Column) -> tuple[Column, Column]:
    return speed * F.sin(F.radians(angle)), speed * F.cos(F.radians(angle))


def logit_score(terms: Mapping[str, float], column=F.col) -> Column:
    """Probability of a logistic model given as {term: coefficient}, with "const" for the intercept."""
    z = F.lit(float(terms.get("const", 0.0)))
    for name, value in terms.items():
        if name != "const":
            z = z + F.lit(float(value)) * column(name)
    return 1 / (1 + F.exp(-z))


def minmax_scale(value: Column, low: Column, high: Column) -> Column:
    """By the training bounds, never the data's own."""
    return (value - low) / (high - low)


def storm_class(long_axis: float = 100, slender: float = 3, shear: float = 4, top: float = 7) -> Column:
    """Six storm classes of rows with major_axis_length, minor_axis_length, local_max, max_alt and azi_shear.

    Rotating storms take precedence, long ones of them first; then number of cells and size decide; else null.
    """
    long = F.col("major_axis_length") >= long_axis
    aspect = ratio(F.col("major_axis_length"), F.col("minor_axis_length"))
    rotating = (F.col("max_alt") >= top) & (F.col("azi_shear") > shear)
    return (
        F.when(rotating & long, "Embedded supercell")
        .when(rotating & ~long, "Supercellular")
        .when(~long & (F.col("local_max") >= 2), "Cell cluster")
        .when(F.col("local_max") == 1, "Cellular")
        .when(long & (aspect < slender), "Non-linear")
        .when(long & (aspect >= slender), "Linear")
    )


def storm_class_v0(long_axis: float = 100, slender: float = 3, shear: float = 4.5, shallow: Column | None = None) -> Column:
    """The earlier rule set: storms of little depth (a condition, if given) first, and no rotating long storms."""
    long = F.col("major_axis_length") >= long_axis
    aspect = ratio(F.col("major_axis_length"), F.col("minor_axis_length"))
    return (
        F.when(F.lit(False) if shallow is None else shallow, "Shallow")
        .when(~long & (aspect < slender) & (F.col("azi_shear") >= shear), "Supercellular")
        .when(~long & (F.col("local_max") > 1), "Cell cluster")
        .when(~long & (F.col("local_max") == 1), "Cellular")
        .when(long & (aspect < slender), "Non-linear")
        .when(long & (aspect >= slender), "Linear")
    )


def relabel(value: Column, names: Mapping[int, int]) -> Column:
    out = F.lit(None).cast("long")
    for old, new in names.items():
        out = F.when(value == old, F.lit(new).cast("long")).otherwise(out)
    return out


def scw_flag(gust: Column, gust_ratio: Column, near: Column, least_gust: float = 25.0, least_ratio: float = 2.0) -> Column:
    """Severe: strong, much above its surroundings in time, and near a storm."""
    return F.coalesce((gust >= least_gust) & (gust_ratio >= least_ratio) & (near == 1), F.lit(False))


def lightning_qualified(scw: Column, strokes: Column, least: int = 2) -> Column:
    """Severe with as many strokes around."""
    return F.coalesce((scw == 1) & (strokes >= least), F.lit(False))


def potential_temp(t_kelvin: Column, p_hpa: Column) -> Column:
    return t_kelvin * F.pow(1000.0 / p_hpa, F.lit(0.2854))


def dewpoint_from_rh(t_celsius: Column, rh_percent: Column) -> Column:
    """Magnus form."""
    g = F.log(rh_percent / 100) + 17.625 * t_celsius / (243.04 + t_celsius)
    return 243.04 * g / (17.625 - g)


def rotate_wind(u: Column, v: Column, mean_u: Column, mean_v: Column) -> tuple[Column, Column]:
    """Components along and across the mean wind."""
    angle = F.atan2(mean_v, mean_u)
    return u * F.cos(angle) + v * F.sin(angle), v * F.cos(angle) - u * F.sin(angle)


def only_where(condition: Column, names: Sequence[str]) -> dict[str, Column]:
    """The named columns, null where the condition does not hold."""
    return {n: F.when(condition, F.col(n)) for n in names}
