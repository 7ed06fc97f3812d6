"""Choosing events: declustering, non-events, chains of strongest rows, cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeworks.operators.chains import BLOCK_ROWS, first_beyond, reached, strongest_ahead
from galeworks.operators.ordered import carried


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_n(df: DataFrame, keys: Sequence[str], order: Column, fields: Sequence[str], n: int) -> DataFrame:
    """(keys, place, fields) of the first n rows of each key by `order` (ascending): the best of each task's rows meet, no key is sorted whole."""
    by = df.withColumn("__o", order).withColumn("__salt", F.pmod(F.xxhash64(F.col("__o")), F.lit(64)))
    some = by.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__o"))).where(F.col("__k") <= n)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__o")).cast("long")).where(F.col("place") <= n).select(*keys, "place", *fields)


def pick_cases(df: DataFrame, location: str, serves: Column, order: Sequence[Column], most: int) -> DataFrame:
    """df (event_id, location, stormless, radarless, ...) with label: 1 for the first `most` rows of a location with storm and radar, 2 for its others,
    3 without storm, 4 without radar. Locations with fewer than `most` chosen are filled up from the location that `serves` them: its first
    rows stand again, under the location that they fill up, with label 5.
    """
    n = F.row_number().over(Window.partitionBy(location, "stormless", "radarless").orderBy(*order))
    ranked = df.withColumn("__n", n)
    full = ~F.col("stormless") & ~F.col("radarless")
    own = ranked.groupBy(location).agg(F.count_if(full & (F.col("__n") <= most)).alias("__have"))
    label = F.when(F.col("radarless"), 4).when(F.col("stormless"), 3).when(F.col("__n") <= most, 1).otherwise(2)
    more = ranked.where(full).withColumn(location, serves).join(own, location).where(F.col("__n") <= most - F.col("__have")).withColumn("label", F.lit(5)).drop("__have")
    return ranked.withColumn("label", label).unionByName(more).drop("__n")


def non_events(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each key by `order` (events first), kept only where it is no event."""
    return top1(df, keys, order).where("scw = 0")


def decluster_forward(df: DataFrame, keys: Sequence[str], time: str, strength: str, tie: str, window: float = 3600, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, time, strength, tie) of events that stay: from each survivor the strongest within `window` ahead remains.

    From a row the strongest of the window ahead comes next, if it is stronger (of equals the first one); if none is, the row stays, and the
    first row beyond its window comes next. So each row has one next row, and what stays is what the first row of its keys leads to:
    chains.reached follows it over blocks of time, and a series without gaps is no longer an array than others. Rows at one
    time are ordered by tie, a number.
    """
    return reached(df, keys, time, strength, tie, window, strongest_ahead, block_rows)


def decluster_group(df: DataFrame, keys: Sequence[str], time: str, strength: str, tie: str, window: float = 3600, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `seed`, the time of the first row of its greedy group: rows less than `window` after the group's first row.

    Groups' first rows follow from one another as in decluster_forward; each row then takes the last one at or before it, carried over ranges of time.
    """
    seeds = reached(df, keys, time, strength, tie, window, first_beyond, block_rows).select(*keys, time).distinct()
    both = df.withColumn("__side", F.lit(1)).unionByName(seeds.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    return carried(both, keys, [time, "__side"], {"seed": F.when(F.col("__side") == 0, F.col(time))}, sketch=df).where("__side = 1").drop("__side")
