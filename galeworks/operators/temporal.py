"""Joins and windows in time. Times are timestamps; widths are seconds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeworks.functions.exprs import micros
from galeworks.operators.ordered import RANGE, carried, running_totals, with_ranges

SECOND = 1_000_000


def frame(keys: Sequence[str], time: str, before: float, after: float):
    """Rows of the same keys from `before` seconds earlier to `after` seconds later, both ends closed."""
    return Window.partitionBy(*keys).orderBy(micros(F.col(time))).rangeBetween(int(-before * SECOND), int(after * SECOND))


def rolling_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, before: float, after: float, least: int, name: str, require_end: bool = False) -> DataFrame:
    """Mean over a time frame; null below `least` values or, if asked, unless a row lies exactly at the frame's later end."""
    w = frame(keys, time, before, after)
    enough = F.count(value).over(w) >= least
    if require_end:
        enough = enough & (F.max(micros(F.col(time))).over(w) == micros(F.col(time)) + int(after * SECOND))
    return df.withColumn(name, F.when(enough, F.avg(value).over(w)))


def rolling_median(df: DataFrame, keys: Sequence[str], time: str, value: str, before: float, after: float, least: int, name: str) -> DataFrame:
    """Exact median over a time frame; Spark has no framed median, so the frame's values are sorted as an array."""
    values = F.array_sort(F.collect_list(value).over(frame(keys, time, before, after)))
    n = F.size("__values")
    middle = (F.get("__values", F.floor((n - 1) / 2).cast("int")) + F.get("__values", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("__values", values).withColumn(name, F.when(n >= least, middle)).drop("__values")


def _meeting(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str]) -> DataFrame:
    """Both sides as rows of (keys, __t, __side, __right, __left) in one time order; at one time the right rows come first."""
    struct = F.struct(F.col(right_time), *[F.col(c) for c in fields])
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), struct.alias("__right"))
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    return r.unionByName(l, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, fields: Sequence[str], tolerance: float, clip_to_last: bool = False) -> DataFrame:
    """Each left row with the fields and time of the latest right row of its keys at or before it and within tolerance.

    Union and a carried last row over ranges of time: one shuffle, no pairs, and a key of any size. Rows without a match go. With
    clip_to_last, left rows after the last right row of their keys go as well. Of right rows at one time the one with the largest fields is taken.
    """
    both = _meeting(left, right, keys, left_time, right_time, fields)
    stop = {"__stop": F.col("__right")} if clip_to_last else {}
    both = carried(both, keys, ["__t", "__side", "__right"], {"__found": F.col("__right")}, final=stop)
    fits = (F.col("__side") == 1) & (micros(F.col("__t")) - micros(F.col(f"__found.{right_time}")) <= int(tolerance * SECOND))
    if clip_to_last:
        fits = fits & (F.col("__t") <= F.col(f"__stop.{right_time}"))
    return both.where(fits).select("__left.*", "__found.*")


def nearest_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, field: str, tolerance: float) -> DataFrame:
    """Each left row with the time and field of the right row of its keys closest in time (ties: the earlier); a key may be of any size."""
    both = carried(_meeting(left, right, keys, left_time, right_time, [field]), keys, ["__t", "__side", "__right"], {"__back": F.col("__right")}, {"__ahead": F.col("__right")}).where("__side = 1")
    gap = lambda c: F.abs(micros(F.col("__t")) - micros(F.col(f"{c}.{right_time}")))
    pick = F.when(F.col("__ahead").isNull() | (gap("__back") <= gap("__ahead")), F.col("__back")).otherwise(F.col("__ahead"))
    both = both.withColumn("__found", pick)
    return both.where(gap("__found") <= int(tolerance * SECOND)).select("__left.*", "__found.*")


def regular_fill(df: DataFrame, keys: Sequence[str], time: str, value: str, step: str, unit: str, limit: int) -> DataFrame:
    """A regular grid of steps from each key's first to its last row, forward filled for at most `limit` steps; rows without keys hold no value.

    A row covers the steps up to its keys' next row, so the grid arises from rows once their next is known: what is shuffled are the rows, not the grid.
    """
    floored = df.groupBy(*keys, F.date_trunc(unit, time).alias("slot")).agg(F.max_by(value, time).alias(value)).where("slot is not null")
    if step != f"1 {unit}":  # rows may lie between steps, so the grid is made first
        spine = floored.groupBy(*keys).agg(F.min("slot").alias("a"), F.max("slot").alias("b")).select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("slot"))
        filled = carried(spine.join(floored, [*keys, "slot"], "left"), keys, ["slot"], {"__known": F.when(F.col(value).isNotNull(), F.struct("slot", value))}, sketch=spine)
        return filled.withColumn(value, F.when(F.expr(f"__known.slot + {limit} * interval {step} >= slot"), F.col(f"__known.{value}"))).drop("__known")
    dealt = with_ranges(floored, "slot", df.select(F.date_trunc(unit, time).alias("slot")))
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    dealt = dealt.withColumn("__own", F.when(known, F.struct("slot", value)))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    within, by = Window.partitionBy(*keys, RANGE).orderBy("slot"), Window.partitionBy(*keys).orderBy(RANGE)
    near = dealt.withColumns({"__known": F.last("__own", True).over(within.rowsBetween(first, 0)), "__next": F.lead("slot").over(within)})
    # Of a range, what others need to know: its last value for those after it, its first row for those before; the ends look them up.
    ends = near.groupBy(*keys, RANGE).agg(F.max("__known").alias("__end"), F.min("slot").alias("__begin"))
    far = ends.select(*keys, RANGE, F.last("__end", True).over(by.rowsBetween(first, -1)).alias("__far"), F.first("__begin").over(by.rowsBetween(1, last)).alias("__after"))
    met = near.select(*keys, RANGE, "slot", "__known", "__next").join(far.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, RANGE]}), _all_same([*keys, RANGE]))
    until = F.coalesce("__next", "__after")
    steps = F.when(until.isNull(), F.array("slot")).otherwise(F.expr(f"sequence(slot, coalesce(__next, __after) - interval {step}, interval {step})"))
    # Until when a value holds is worked out once a row, not once a step.
    held = met.withColumn("__known", F.coalesce("__known", "__far")).withColumns({"__till": F.expr(f"__known.slot + {limit} * interval {step}"), "__held": F.col(f"__known.{value}")})
    every = held.select(*keys, F.explode(steps).alias("slot"), "__till", "__held")
    return every.withColumn(value, F.when(F.col("__till") >= F.col("slot"), F.col("__held"))).drop("__till", "__held")


def _all_same(columns: Sequence[str]) -> Column:
    """Whether columns equal those named __of_<column>; null keys meet."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return same


def interpolate_linear(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Nulls replaced on the line between their neighbours by row count; a trailing gap holds the last value. A key may be of any size."""
    counted = running_totals(with_ranges(df.withColumn("__one", F.lit(1)), order), keys, [order], ["__one"]).withColumn("__n", F.col("before___one"))
    known = F.when(F.col(value).isNotNull(), F.struct("__n", value))
    df = carried(counted, keys, ["__n"], {"__a": known}, {"__b": known})
    a, b = F.col(f"__a.{value}"), F.col(f"__b.{value}")
    line = a + (b - a) * (F.col("__n") - F.col("__a.__n")) / (F.col("__b.__n") - F.col("__a.__n"))
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.col(value)).when(b.isNull(), a).otherwise(line)).drop("__n", "__a", "__b", "__one", "before___one", "all___one", RANGE)


def pad_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, name: str) -> DataFrame:
    """df with `name`: the value's last one that is not null, at the row or earlier."""
    return carried(df, keys, order, {name: F.col(value) if isinstance(value, str) else value})


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of the value up to and with the row; null until the first value."""
    ran = running_totals(df.withColumns({"__v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "__c": F.col(value).isNotNull().cast("long")}), keys, order, ["__v", "__c"])
    total = F.when(F.col("before___c") + F.col("__c") > 0, F.col("before___v") + F.col("__v"))
    return ran.withColumn(name, total).drop(*[f"{p}__{c}" for p in ("", "before_", "all_") for c in "vc"])


def shift_hour(df: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    """Value of the next hour of the same keys; where none follows, the last known one."""
    ahead = df.select(*keys, (F.col(hour) - 1).alias(hour), F.col(value).alias("__next"))
    joined = df.join(ahead, [*keys, hour], "left")
    return carried(joined, keys, [hour], {"__known": F.col("__next")}, sketch=df).withColumn(value, F.col("__known")).drop("__next", "__known")


#: Sums of windows are exact to 15 decimal places, so that neither their order nor what stands outside a window shows in them.
_EXACT = "decimal(38,16)"


def windows_sums(events: DataFrame, series: DataFrame, keys: Sequence[str], row: str, event_time: str, series_time: str, value: str, windows: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Every event with, for each window {name: (before, after)} in seconds around it, both ends closed: n_, missing_, total_ and mean_<name> of
    the series of its keys (values that are there, nulls, their sum and mean). `row` is a column that names each event.

    Differences of running sums: a window's two ends meet the series in one time order, over ranges of time, so rows are those of the series and
    two for an event and window, however long the windows. Events without series stay, with counts of 0; events alike in all
    but `row` stay apart. A window that holds NaN or an infinity sums to NaN. Values must lie below 1e22.
    """
    at = micros(F.col(event_time))
    ends = [F.struct(F.lit(k).alias("w"), F.lit(sign).alias("sign"), (at + F.lit(int(sign * (a if sign > 0 else b) * SECOND))).alias("t"), F.lit(sign).alias("side")) for k, (b, a) in enumerate(windows.values()) for sign in (-1, 1)]
    looks = events.where(F.col(event_time).isNotNull()).select(row, *keys, F.explode(F.array(*ends)).alias("e")).select(row, *keys, F.col("e.w").alias("__w"), F.col("e.t").alias("__t"), F.col("e.side").alias("__side"))
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    rows = series.where(F.col(series_time).isNotNull()).select(
        *keys, micros(F.col(series_time)).alias("__t"), F.lit(0).alias("__side"), v.isNotNull().cast("long").alias("__n"), v.isNull().cast("long").alias("__m"), F.coalesce(odd, F.lit(False)).cast("long").alias("__o"), F.when(~odd, v).cast(_EXACT).alias("__s")
    )
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    sums = ["__n", "__m", "__o", "__s"]
    both = rows.unionByName(looks, allowMissingColumns=True).fillna(0, sums[:3]).withColumn("__s", F.coalesce("__s", F.lit(0).cast(_EXACT)))
    ran = running_totals(both, keys, ["__t", "__side"], sums, sketch=rows).where("__side <> 0")
    # Taken off rather than multiplied by the side: a product of decimals keeps 6 places.
    of = lambda c, k: F.sum(F.when(F.col("__w") == k, F.when(F.col("__side") > 0, F.col(f"before_{c}")).otherwise(-F.col(f"before_{c}"))))
    found = ran.groupBy(row).agg(*[of(c, k).alias(f"{c}{k}") for k in range(len(windows)) for c in sums])
    out = []
    for k, name in enumerate(windows):
        n, total = F.col(f"__n{k}"), F.when(F.col(f"__o{k}") > 0, F.lit(float("nan"))).when(F.col(f"__n{k}") > 0, F.col(f"__s{k}").cast("double"))
        out += [n.alias(f"n_{name}"), F.col(f"__m{k}").alias(f"missing_{name}"), total.alias(f"total_{name}"), (total / n).alias(f"mean_{name}")]
    return events.join(found.select(row, *out), row, "left").fillna(0, [f"{c}_{name}" for name in windows for c in ("n", "missing")])


def window_sums(events: DataFrame, series: DataFrame, keys: Sequence[str], row: str, event_time: str, series_time: str, value: str, before: float, after: float) -> DataFrame:
    """windows_sums of one window, with columns n, missing, total and mean."""
    found = windows_sums(events, series, keys, row, event_time, series_time, value, {"w": (before, after)})
    return found.withColumnsRenamed({f"{c}_w": c for c in ("n", "missing", "total", "mean")})


def lookup_with_gap(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, left_time: str, right_time: str, field: str, step: float) -> DataFrame:
    """Left rows with `field` of the right row of their keys in the same step (a minute, say), else in the step before; others go.

    Of several right rows in a step the latest counts. `row` is a column that names each left row.
    """
    slot = lambda t: F.floor(micros(F.col(t)) / int(step * SECOND))
    r = right.groupBy(*keys, slot(right_time).alias("__slot")).agg(F.max(F.struct(right_time, field)).alias("__r"))
    l = left.withColumn("__own", slot(left_time)).withColumn("__slot", F.explode(F.array(F.col("__own"), F.col("__own") - 1)))
    best = l.join(r, [*keys, "__slot"]).groupBy(row).agg(F.max_by(F.col(f"__r.{field}"), "__slot").alias(field))
    return left.join(best, row)


def upsample_nearest(df: DataFrame, keys: Sequence[str], hour: str, step: int, name: str = "target") -> DataFrame:
    """The rows of df at multiples of step, at every whole hour up to each key's last row, by the nearest of them (ties: the later)."""
    hours = df.groupBy(*keys).agg(F.max(hour).alias("__top")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__top").cast("long"))).alias(name))
    return hours.withColumn(hour, F.floor((F.col(name) + step // 2) / step) * step).join(df, [*keys, hour])


def resample_count_distinct(df: DataFrame, keys: Sequence[str], time: str, what: str, unit: str, name: str = "n") -> DataFrame:
    """(keys, slot, name): different values of `what` in each unit of time between each key's first and last row, 0 where there is none."""
    slots = df.withColumn("slot", F.date_trunc(unit, time))
    spine = slots.groupBy(*keys).agg(F.min("slot").alias("__a"), F.max("slot").alias("__b")).select(*keys, F.explode(F.expr(f"sequence(__a, __b, interval 1 {unit})")).alias("slot"))
    return spine.join(slots.groupBy(*keys, "slot").agg(F.count_distinct(what).alias(name)), [*keys, "slot"], "left").fillna(0, [name])


def completeness(df: DataFrame, keys: Sequence[str], time: str, before: float, after: float, expected: int) -> Column:
    return F.count(F.lit(1)).over(frame(keys, time, before, after)) / expected
