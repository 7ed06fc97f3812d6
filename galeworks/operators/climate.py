"""Counts, distributions and changes over seasons, classes and ensembles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeworks.operators.ordered import exact_quantiles, running_totals


def days_per_month(df: DataFrame, keys: Sequence[str], day: Column, flags: Mapping[str, Column]) -> DataFrame:
    """Days of each month on which a flag holds at any step, for each flag."""
    daily = df.groupBy(*keys, F.date_trunc("day", day).alias("__day")).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    return daily.groupBy(*keys, F.year("__day").alias("yr"), F.month("__day").alias("mon")).agg(*[F.count_if(n).alias(n) for n in flags])


def cluster_climatology(grid: DataFrame, keys: Sequence[str], time: str, cluster: Column, clusters: int, score: Column, least: float) -> DataFrame:
    """Days of each month, for each of keys (a place; a model and period as well), on which it lies in each cluster (c0, c1, ...), scores above `least`
    (severe), and does both (severe0, severe1, ...). One pass over the grid, whatever the models and periods."""
    marked = grid.withColumns({"__c": cluster, "__s": score > least})
    flags = {f"c{k}": F.col("__c") == k for k in range(clusters)} | {"severe": F.col("__s")} | {f"severe{k}": F.col("__s") & (F.col("__c") == k) for k in range(clusters)}
    return days_per_month(marked, keys, F.col(time), flags)


def mask_missing_points(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """`value` null at every step of a point whose first step lacks it."""
    first = df.groupBy(*keys).agg(F.min_by(F.col(value).isNull(), time).alias("__gone"))
    return df.join(first, list(keys)).withColumn(value, F.when(~F.col("__gone"), F.col(value))).drop("__gone")


def share_of_all(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Relative frequency of each group of rows among all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy()))


def box_summary(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles of each group, its last values within `reach` times their distance, and its full range (least, most)."""
    q = exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    over = reach * (F.col("q75") - F.col("q25"))
    inside = F.when(F.col(value).between(F.col("q25") - over, F.col("q75") + over), F.col(value))
    return df.join(q, list(keys)).groupBy(*keys, "q25", "q50", "q75").agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.min(value).alias("least"), F.max(value).alias("most"))


def bins(value: Column, low: float, high: float, n: int) -> Column:
    """Index of one of n even bins; the last one holds its upper end; null outside."""
    return F.when(value.between(low, high), F.least(F.floor((value - low) * n / (high - low)), F.lit(n - 1)))


def hist2d(df: DataFrame, x: Column, y: Column, nx: int, ny: int) -> DataFrame:
    """Dense (bx, by, n, percent) over bin indices; empty bins are zero."""
    counts = df.select(x.alias("bx"), y.alias("by")).where("bx is not null and by is not null").groupBy("bx", "by").agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).alias("bx"), (F.col("id") % ny).alias("by"))
    full = spine.join(counts, ["bx", "by"], "left").fillna(0, ["n"])
    return full.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks with ties at their middle; rows meet by value first, so only distinct values are ordered."""
    by = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(by, keys, [value], ["__n"], sketch=df)
    return df.join(ran.select(*keys, value, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(name)), [*keys, value])


def ensemble_share_change(df: DataFrame, model: str, period: str, point: str, condition: Column, flag: Column) -> DataFrame:
    """Change from past to future of the share of `flag` where `condition` holds: median over models, and how many agree in sign."""
    share = df.groupBy(model, point).pivot(period, ["past", "future"]).agg(F.count_if(condition & flag) / F.nullif(F.count_if(condition), F.lit(0)))
    diff = share.select(point, (F.col("future") - F.col("past")).alias("d"))
    return diff.groupBy(point).agg(F.median("d").alias("change"), F.greatest(F.count_if(F.col("d") > 0), F.count_if(F.col("d") < 0)).alias("same_sign"))


def filter_small_objects(cells: DataFrame, keys: Sequence[str], label: str, value: Column, least_cells: int, least_strong: int, least_depth: float) -> DataFrame:
    """Cells of the labels with enough cells, enough strong ones and enough depth (column z); labels are numbered anew from 1."""
    good = cells.groupBy(*keys, label).agg(F.count("*").alias("__c"), F.count_if(value).alias("__s"), (F.max("z") - F.min("z")).alias("__d"))
    good = good.where((F.col("__c") >= least_cells) & (F.col("__s") >= least_strong) & (F.col("__d") >= least_depth))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(label))
    return cells.join(good.select(*keys, label, number.alias("object")), [*keys, label])


def conditional_shares(df: DataFrame, sets: Sequence[Sequence[str]], shares: Mapping[str, tuple[Column, Column | None]], scale: float = 1.0) -> DataFrame:
    """For each grouping of `sets` the share of rows that fulfil the first condition among those that fulfil the second (all, if None), times scale.

    All groupings and shares come from one aggregate; a share of no rows is null.
    """
    names = list(dict.fromkeys(c for own in sets for c in own))
    share = lambda hit, of: scale * F.count_if(hit) / F.count("*") if of is None else scale * F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0))
    return df.groupingSets([list(own) for own in sets], *names).agg(*[share(hit, of).alias(n) for n, (hit, of) in shares.items()])


def class_frequency(df: DataFrame, keys: Sequence[str], kind: str, event: str) -> DataFrame:
    """(keys, kind, events, share, rate, odds) of each class in each of keys, and over all rows (keys null): its part of the events there, its
    percentage of events, and events over non-events."""
    c = df.groupingSets([[kind], [*keys, kind]], *keys, kind).agg(F.sum(event).alias("events"), F.count("*").alias("n"))
    e, n = F.col("events"), F.col("n")
    every = F.sum("events").over(Window.partitionBy(*keys))  # classes are few
    return c.select(*keys, kind, "events", (e / F.nullif(every, F.lit(0))).alias("share"), (100.0 * e / n).alias("rate"), (e / F.nullif(n - e, F.lit(0))).alias("odds"))


def station_years(df: DataFrame, keys: Sequence[str], first: Column, last: Column, quality: Column, closed: bool = True) -> DataFrame:
    """(keys, stations, qc, years): stations, their mean quality in percent, and their years from first to last, weighted by it. `closed` counts both ends."""
    span = last - first + (1 if closed else 0)
    return df.groupBy(*keys).agg(F.count("*").alias("stations"), F.avg(quality).alias("qc"), F.sum(F.when(last >= first, span).otherwise(0) * quality / 100).alias("years"))


def radar_summary(df: DataFrame, radar: str, fields: Sequence[str], station: str, event: Column, rows_a_year: float) -> DataFrame:
    """(radar, fields, stations, years, n_events, per_year) of a radar's rows, of which a full station-year has rows_a_year; fields are those of the radar."""
    years, events = F.count("*") / rows_a_year, F.count_if(event)
    return df.groupBy(radar).agg(*[F.first(f).alias(f) for f in fields], F.count_distinct(station).alias("stations"), years.alias("years"), events.alias("n_events"), (events / years).alias("per_year"))


def yearly_mean(df: DataFrame, keys: Sequence[str], year: str, value: str, name: str) -> DataFrame:
    """Sum of the value over the years that have rows, for each key."""
    return df.groupBy(*keys).agg((F.sum(value) / F.count_distinct(year)).alias(name))


def season(month: Column) -> Column:
    """0 for December to February, then by threes."""
    return F.floor(month % 12 / 3).cast("int")


def ensemble_median(df: DataFrame, model: str, keys: Sequence[str], year: str, value: str, name: str) -> DataFrame:
    """Median over models of each model's yearly mean, for each key."""
    return yearly_mean(df, [model, *keys], year, value, "__d").groupBy(*keys).agg(F.median("__d").alias(name))


def ensemble_change(df: DataFrame, model: str, period: str, keys: Sequence[str], year: str, value: str, agree: int, least: float) -> DataFrame:
    """(keys, change, same_sign, past_mean, agreed): median over models of the change of the yearly mean from past to future; agreed, where `agree` models
    share its sign and the past mean is `least` or more. One aggregate of each model's two periods, and one over models."""
    s = yearly_mean(df, [model, period, *keys], year, value, "__d").groupBy(model, *keys).pivot(period, ["past", "future"]).agg(F.first("__d")).where("past is not null and future is not null")
    d = F.col("future") - F.col("past")
    out = s.groupBy(*keys).agg(F.median(d).alias("change"), F.greatest(F.count_if(d > 0), F.count_if(d < 0)).alias("same_sign"), F.avg("past").alias("past_mean"))
    return out.withColumn("agreed", (F.col("same_sign") >= agree) & (F.col("past_mean") >= least))


def circular_smooth(df: DataFrame, keys: Sequence[str], place: str, value: str, n: int, name: str) -> DataFrame:
    """(keys, place, name): mean of each place of a circle of n (numbered from 1) with its two neighbours, of those that have rows."""
    spread = df.withColumn(place, F.explode(F.array(F.col(place), F.col(place) % n + 1, (F.col(place) + n - 2) % n + 1)))
    return spread.groupBy(*keys, place).agg(F.avg(value).alias(name))


def attach_counts(df: DataFrame, what: str, counts: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with, for each name, the number of different `what` among the rows that agree with the row in the named keys."""
    out = df
    for name, keys in counts.items():
        out = out.join(df.groupBy(*keys).agg(F.count_distinct(what).alias(name)), list(keys))
    return out


def attach_covered(df: DataFrame, values: DataFrame, keys: Sequence[str], value: str, covered: Column) -> DataFrame:
    """df with the joined value where it is covered, which then must be there; other rows are kept with null."""
    joined = df.join(values.select(*keys, value), list(keys), "left").where(~covered | F.col(value).isNotNull())
    return joined.withColumn(value, F.when(covered, F.col(value)))
