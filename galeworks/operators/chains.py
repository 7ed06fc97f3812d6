"""Rows that lead from one to the next: which of them are reached from the first, in groups of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeworks.functions.exprs import micros
from galeworks.sources.readers import scratch

#: Rows that a block of time should hold, on average over the densest keys; it bounds what a task holds at once.
BLOCK_ROWS = 100_000

#: For the rows of a block and what follows it within a window (times, strengths, in order), and the width: each row's next row
#: (len(times) where that lies beyond), and whether the row stays if it is reached.
Rule = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def first_beyond(times: np.ndarray, strengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row `width` or more later comes next; every row that is reached stays."""
    return np.searchsorted(times, times + width, "left"), np.ones(len(times), bool)


def strongest_ahead(times: np.ndarray, strengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row stays if none of its window ahead is stronger, and the first row beyond comes next; else the window's (first) strongest comes next.

    Windows' maxima come from a table of maxima over stretches of powers of two. Null strengths neither replace a row nor are replaced.
    """
    n, beyond = len(times), np.searchsorted(times, times + width, "left")
    known = np.where(np.isnan(strengths), -np.inf, strengths)
    place = np.lexsort((-np.arange(n), known)).argsort()  # ranks by strength; of equals the earlier is larger
    level, at = [place], 1
    while 2 * at <= n:
        level.append(np.maximum(level[-1][:-at], level[-1][at:]))
        at *= 2
    begin, size = np.arange(n), np.maximum(beyond - np.arange(n), 1)
    top, power = np.empty(n, np.int64), np.frexp(size.astype("f8"))[1] - 1
    for k in np.unique(power):
        own = power == k
        top[own] = np.maximum(level[k][begin[own]], level[k][begin[own] + size[own] - (1 << k)])
    best = np.argsort(place)[top]
    stays = (best == begin) | np.isnan(strengths) | ~(known[best] > known)
    return np.where(stays, beyond, best), stays


def reached(df: DataFrame, keys: Sequence[str], time: str, strength: str, tie: str, window: float, rule: Rule, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, time, strength, tie) of the rows that are reached from the first row of their keys, and stay, by `rule`.

    Time is cut into blocks, eight windows long at least. A task follows the rows of one block of one key; rows of the window after a block stand
    in both. Where several blocks hold a key, each row at which a block can be entered (those of its first window, and the first after it) gets
    the row at which it leaves it. Which entries are reached then follows by doubling steps over these rows alone, in as many rounds as
    the logarithm of the blocks. So no array holds a run, however long it is, and no block waits for the one before.
    """
    width = int(window * 1_000_000)
    kinds = dict(df.dtypes)
    # Events are few against the series that they are found in, and are read several times: so they are written once.
    own_tie = F.col(tie).cast("long")
    rows = df.select(*keys, F.col(time).alias("__time"), micros(F.col(time)).alias("__m"), F.col(strength).cast("double").alias("__x"), own_tie.alias("__tie"), F.coalesce(own_tie, F.lit(-(1 << 63))).alias("__name"))
    rows = stored(rows.where("__m is not null"), "events")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__m").alias("low"), F.max("__m").alias("high")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    out = lambda found: found.select(*keys, F.col("__time").alias(time), F.col("__x").cast(kinds[strength]).alias(strength), F.col("__tie").cast(kinds[tie]).alias(tie))
    if whole.low is None:
        return out(rows)
    span = whole.high - whole.low + 1
    length = max(8 * width, math.ceil(span / max(1, math.ceil(whole.most / block_rows))))
    blocks = math.ceil(span / length)
    block = F.floor((F.col("__m") - whole.low) / length).cast("long")
    own = rows.withColumns({"__block": block, "__own": F.lit(True)})
    halo = own.where((F.col("__block") > 0) & ((F.col("__m") - whole.low) % length < width)).withColumns({"__block": F.col("__block") - 1, "__own": F.lit(False)})
    dealt = (own.unionByName(halo) if blocks > 1 else own).select(*keys, "__time", "__m", "__x", "__tie", "__name", "__block", "__own")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups are dealt to so many tasks, however small they are
    if blocks == 1:  # no key needs parting: keys share groups of about block_rows rows, so that many small ones cost little
        groups = max(parts, math.ceil(whole.rows / block_rows))
        shared = dealt.withColumn("__block", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(groups)).cast("long"))
        return out(shared.repartition(parts, "__block").groupBy("__block").applyInPandas(_many_walker(rule, width, list(keys)), shared.schema))

    # Entries of blocks and where the walks from them leave to. A row is named by its time, its tie and its number among rows alike in both.
    entries = dealt.repartition(parts, *keys, "__block").groupBy(*keys, "__block").applyInPandas(_exits(rule, width, whole.low, length, len(keys)), _entry_schema(dealt, keys))
    table = stored(entries, "entries")
    firsts = table.where("first").select(*keys, "block", "m", "tie", "nth")
    lates = table.where("late").select(*keys, "block", "m", "tie", "nth")
    # What lies beyond a block and the window after it: the next block's late row, if it has one, else the first row of the blocks after that.
    by = Window.partitionBy(*keys).orderBy("block")
    known = firsts.select(*keys, "block", F.struct("block", "m", "tie", "nth").alias("f")).join(lates.select(*keys, "block", F.struct("block", "m", "tie", "nth").alias("l")), [*keys, "block"], "left")
    after = F.when(F.lead("block").over(by) > F.col("block") + 1, F.lead("f").over(by)).otherwise(F.coalesce(F.lead("l").over(by), F.lead("f", 2).over(by)))
    beyond = known.select(*keys, "block", after.alias("far"))
    to = F.when(F.col("to_m").isNull(), F.col("far")).otherwise(F.struct((F.col("block") + 1).alias("block"), F.col("to_m").alias("m"), F.col("to_tie").alias("tie"), F.col("to_nth").alias("nth")))
    jumps = stored(table.join(beyond, [*keys, "block"]).select(*keys, F.struct("block", "m", "tie", "nth").alias("at"), to.alias("to")).where("to is not null"), "jumps")

    steps = [jumps]
    while 1 << len(steps) < blocks:
        last = steps[-1]
        twice = last.join(last.select(*keys, F.col("at").alias("to"), F.col("to").alias("then")), [*keys, "to"]).select(*keys, "at", F.col("then").alias("to"))
        steps.append(stored(twice, "jumps"))
    found = table.where("first").groupBy(*keys).agg(F.min(F.struct("block", "m", "tie", "nth")).alias("at"))
    for jump in reversed(steps):
        found = stored(found.unionByName(found.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at"))), "reached")
    enter = found.groupBy(*keys, F.col("at.block").alias("__block")).agg(F.min(F.struct("at.m", "at.tie", "at.nth")).alias("e"))
    entered = dealt.join(enter.select(*keys, "__block", F.col("e.m").alias("__em"), F.col("e.tie").alias("__et"), F.col("e.nth").alias("__en")), [*keys, "__block"])
    kept = entered.repartition(parts, *keys, "__block").groupBy(*keys, "__block").applyInPandas(_walker(rule, width), dealt.schema)
    return out(kept)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that no round repeats those before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _entry_schema(dealt: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(dealt.dtypes)
    return ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "block long, m long, tie long, nth long, first boolean, late boolean, to_m long, to_tie long, to_nth long"])


def _in_order(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by time, tie and strength: their places in group, times, strengths, ties and their numbers among rows alike in time and tie."""
    m, name, x = (group[c].to_numpy() for c in ("__m", "__name", "__x"))
    order = np.lexsort((np.where(np.isnan(x), -np.inf, x), name, m))
    m, name, x = m[order], name[order], x[order]
    fresh = np.concatenate([[True], (np.diff(m) != 0) | (np.diff(name) != 0)])
    nth = np.arange(len(m)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return order, m, x, name, nth


def _many_walker(rule: Rule, width: int, keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the rows of several whole keys those that are reached from the first row of their key, and stay."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        own = group.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(group), np.int64)
        m, name, x = (group[c].to_numpy() for c in ("__m", "__name", "__x"))
        order = np.lexsort((np.where(np.isnan(x), -np.inf, x), name, m, own))
        m, x, ends = m[order], x[order], [*np.flatnonzero(np.diff(own[order])) + 1, len(order)]
        kept, begin = [], 0
        for end in ends:
            ahead, stays = rule(m[begin:end], x[begin:end], width)
            ahead, at = ahead.tolist(), 0
            while at < end - begin:
                if stays[at]:
                    kept.append(begin + at)
                at = ahead[at]
            begin = end
        return group.iloc[order[kept]]

    return walk


def _walker(rule: Rule, width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the rows of one block of one key those that are reached from its entry, and stay."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        order, times, x, names, nth = _in_order(group)
        n = int(group["__own"].sum())  # the block's own rows come before those of the window after it
        ahead, stays = rule(times, x, width)
        at = int(np.flatnonzero((times == group["__em"].iloc[0]) & (names == group["__et"].iloc[0]) & (nth == group["__en"].iloc[0]))[0])
        kept, ahead = [], ahead.tolist()
        while at < n:
            if stays[at]:
                kept.append(at)
            at = ahead[at]
        return group.iloc[order[kept]].drop(columns=["__em", "__et", "__en"])

    return walk


def _exits(rule: Rule, width: int, low: int, length: int, keys: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For the rows at which one block of one key can be entered: the first row outside the block that the walk from there reaches, if near.

    Those are the rows of its first window and (late) the first one after it; `first` is the block's first row.
    """

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        order, times, x, names, nth = _in_order(group)
        n, block = int(group["__own"].sum()), int(group["__block"].iloc[0])
        ahead = rule(times, x, width)[0].tolist()
        leaves = [*range(len(times)), len(times)]
        for i in range(n - 1, -1, -1):
            leaves[i] = leaves[ahead[i]]
        late = int(np.searchsorted(times[:n], low + block * length + width, "left"))
        rows = list(range(min(late + 1, n)))
        to = [leaves[i] for i in rows]
        out = group.iloc[order[rows], :keys].copy()
        out["block"], out["m"], out["tie"], out["nth"] = block, times[rows], names[rows], nth[rows]
        out["first"], out["late"] = [i == 0 for i in rows], [i == late for i in rows]
        for name, values in (("to_m", times), ("to_tie", names), ("to_nth", nth)):
            out[name] = pd.array([int(values[i]) if i < len(times) else None for i in to], "Int64")
        return out

    return exits
