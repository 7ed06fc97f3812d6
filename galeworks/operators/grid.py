"""Regular grids and vertical profiles: blocks, derivatives, smoothing, interpolation, layers, storm motion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeworks.functions.exprs import EARTH_KM, ratio

#: Angular speed of the earth, a second.
OMEGA = 7.292e-5


def coarsen(df: DataFrame, keys: Sequence[str], n: int, values: Sequence[str]) -> DataFrame:
    """Means over blocks of n x n cells (i, j); blocks at the edge hold what there is, nulls are left out."""
    return df.groupBy(*keys, F.floor(F.col("i") / n).alias("bi"), F.floor(F.col("j") / n).alias("bj")).agg(*[F.avg(v).alias(v) for v in values])


def slope(value: Column, axis: Column, keys: Sequence[str], order: str) -> Column:
    """First derivative along an axis: central inside, three points to one side at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = {k: F.lag(value, -k).over(w) for k in (-2, -1, 1, 2)}
    x = {k: F.lag(axis, -k).over(w) for k in (-2, -1, 1, 2)}
    return (
        F.when(x[-1].isNull(), (-3 * value + 4 * v[1] - v[2]) / (x[2] - axis))
        .when(x[1].isNull(), (3 * value - 4 * v[-1] + v[-2]) / (axis - x[-2]))
        .otherwise((v[1] - v[-1]) / (x[1] - x[-1]))
    )


def curvature(value: Column, axis: Column, keys: Sequence[str], order: str) -> Column:
    """Second derivative along an axis of even steps; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = (F.lead(axis).over(w) - F.lag(axis).over(w)) / 2
    return (F.lead(value).over(w) - 2 * value + F.lag(value).over(w)) / (step * step)


def x_km() -> Column:
    return F.radians("lon") * EARTH_KM * F.cos(F.radians("lat"))


def y_km() -> Column:
    return F.radians("lat") * EARTH_KM


def gradient_magnitude(df: DataFrame, time: str, value: str, name: str) -> DataFrame:
    """Length of the horizontal gradient a kilometre, for rows with time, i, j, lat, lon."""
    v = F.col(value)
    both = df.withColumns({"__x": slope(v, x_km(), [time, "i"], "j"), "__y": slope(v, y_km(), [time, "j"], "i")})
    return both.withColumn(name, F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y"))).drop("__x", "__y")


def laplacian_over_f(df: DataFrame, time: str, value: str, name: str) -> DataFrame:
    """Sum of the second derivatives over the Coriolis parameter; null at the edges and on the equator."""
    v = F.col(value)
    f = 2 * OMEGA * F.sin(F.radians("lat"))
    return df.withColumn(name, ratio(curvature(v, x_km(), [time, "i"], "j") + curvature(v, y_km(), [time, "j"], "i"), f))


def kernel(spark, size: int, sigma: float, axis: str) -> DataFrame:
    """Rows (axis, __from, __w): the weights of each place of an axis of `size` places, reflected at the ends."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    at = spark.range(size).select(F.col("id").alias(axis), F.posexplode(F.array(*[F.lit(x / sum(raw)) for x in raw])).alias("__k", "__w"))
    to = F.pmod(F.col(axis) + F.col("__k") - reach, F.lit(2 * size))
    return at.select(axis, F.when(to < size, to).otherwise(2 * size - 1 - to).alias("__from"), "__w")


def gaussian_smooth(df: DataFrame, sizes: dict[str, int], value: str, sigma: float = 1.0) -> DataFrame:
    """A dense histogram smoothed along each axis in turn; both kernels have sizes[axis] * 9 rows for sigma 1."""
    for axis, size in sizes.items():
        others = [a for a in sizes if a != axis]
        k = kernel(df.sparkSession, size, sigma, axis)
        df = df.withColumnRenamed(axis, "__from").join(F.broadcast(k), "__from").groupBy(axis, *others).agg(F.sum(F.col(value) * F.col("__w")).alias(value))
    return df


def surface_prepend(levels: DataFrame, surface: DataFrame, key: str, pressure: str) -> DataFrame:
    """Levels at or above the surface's pressure, and the surface itself as one more level."""
    bound = surface.select(key, F.col(pressure).alias("__ps"))
    return levels.join(bound, key).where(F.col(pressure) <= F.col("__ps")).drop("__ps").unionByName(surface)


def interp_profile(df: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str], targets: Sequence[float] | Column) -> DataFrame:
    """Values of each profile at every target between the levels that bracket it, along an axis of heights or pressures; null outside.

    Targets are the same for all profiles, or a column with an array of them.
    """
    asked = F.array_distinct(targets if isinstance(targets, Column) else F.array(*[F.lit(float(t)) for t in targets]))
    w = Window.partitionBy(*keys).orderBy(axis)
    here, after = F.col(axis), F.col("__next")
    at = df.withColumn("__targets", asked).select(*keys, axis, "__targets", *values, F.lead(axis).over(w).alias("__next"), F.lead(F.lit(1)).over(w).isNull().alias("__last"), (F.row_number().over(w) == 1).alias("__first"), *[F.lead(v).over(w).alias(f"__next_{v}") for v in values])
    # Each target belongs to one level: the last one at or below it, or the first one where none is. So every target has one row without a further meeting.
    own = lambda t: (F.col("__first") | here.isNull() | (t >= here)) & (F.col("__last") | F.coalesce(t < after, F.lit(False)))
    out = at.withColumn("target", F.explode(F.filter("__targets", own)))
    t = F.col("target")
    part = (t - here) / (after - here)
    return out.select(*keys, "target", *[F.when(t == here, F.col(v)).when((t > here) & (t < after), F.col(v) + part * (F.col(f"__next_{v}") - F.col(v))).alias(v) for v in values])


def exact_mean(value: str) -> Column:
    """The mean by sums exact to 16 decimal places, so that it is the same whatever the order of rows; values must lie below 1e22."""
    x = F.col(value)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(F.count_if(odd) > 0, F.avg(x)).otherwise(F.sum(F.when(~odd, x).cast("decimal(38,16)")).cast("double") / F.nullif(F.count(x), F.lit(0)))


def composite_profile(df: DataFrame, keys: Sequence[str], cluster: str, height: str, pressure: str, values: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """(cluster, target, pressure, values): mean profiles at fixed heights. A height's pressure is the mean of the cluster's profiles there,
    and the other values are taken at that pressure and averaged; nulls are left out. A cluster's pressures are as many as targets."""
    at_height = interp_profile(df, [*keys, cluster], height, [pressure], targets)
    mean = at_height.groupBy(cluster, "target").agg(exact_mean(pressure).alias(pressure)).where(F.col(pressure).isNotNull())  # worked out twice, and joined on
    asked = mean.groupBy(cluster).agg(F.collect_set(pressure).alias("__p"))
    at = interp_profile(df.join(asked, cluster), [*keys, cluster], pressure, values, F.col("__p"))
    own = at.groupBy(cluster, F.col("target").alias(pressure)).agg(*[F.avg(v).alias(v) for v in values])
    return mean.join(own, [cluster, pressure]).select(cluster, "target", pressure, *values)


def layer_mean(df: DataFrame, keys: Sequence[str], pressure: str, values: Sequence[str], weighted: bool = True) -> DataFrame:
    """Means weighted by pressure thickness (trapezoids), or plain ones; a single level gives its value."""
    if not weighted:
        return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy(F.desc(pressure))
    at = df.select(*keys, pressure, *values, (F.col(pressure) - F.lead(pressure).over(w)).alias("__d"), *[((F.col(v) + F.lead(v).over(w)) / 2).alias(f"__{v}") for v in values])
    return at.groupBy(*keys).agg(*[F.when(F.count("*") == 1, F.max(v)).otherwise(ratio(F.sum(F.col(f"__{v}") * F.col("__d")), F.sum("__d"))).alias(v) for v in values])


def bunkers_motion(df: DataFrame, keys: Sequence[str], height: str, depth: float = 6000.0, off: float = 7.5) -> DataFrame:
    """Storm motion to the left of the shear: mean wind of the layer and `off` across its shear; without shear, the mean wind."""
    low = df.where(F.col(height) <= depth)
    side = low.groupBy(*keys).agg(F.avg("u").alias("__u"), F.avg("v").alias("__v"), F.max_by(F.struct("u", "v"), height).alias("__top"), F.min_by(F.struct("u", "v"), height).alias("__low"))
    su, sv = F.col("__top.u") - F.col("__low.u"), F.col("__top.v") - F.col("__low.v")
    size = F.sqrt(su * su + sv * sv)
    push = F.when(size > 0, off / size).otherwise(0.0)
    return side.select(*keys, (F.col("__u") - push * sv).alias("motion_u"), (F.col("__v") + push * su).alias("motion_v"))


def storm_relative_helicity(df: DataFrame, motion: DataFrame, keys: Sequence[str], height: str, depth: float = 3000.0) -> DataFrame:
    """Size of the area that the wind, seen from the storm, sweeps between the ground and `depth`."""
    w = Window.partitionBy(*keys).orderBy(height)
    own = df.where(F.col(height) <= depth).join(motion, list(keys)).withColumns({"__u": F.col("u") - F.col("motion_u"), "__v": F.col("v") - F.col("motion_v")})
    swept = F.lead("__u").over(w) * F.col("__v") - F.col("__u") * F.lead("__v").over(w)
    return own.select(*keys, swept.alias("__s")).groupBy(*keys).agg(F.abs(F.sum("__s")).alias("srh"))
