"""Skill scores: contingency tables, threshold sweeps, rank-based AUC, weighted bootstrap, two-sample distance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeworks.operators.ordered import RANGE, running_totals, with_ranges


def contingency(df: DataFrame, keys: Sequence[str], event: str, forecast: Column) -> DataFrame:
    hit = F.col(event) == 1
    return df.groupBy(*keys).agg(
        F.count_if(hit & forecast).alias("hits"), F.count_if(hit & ~forecast).alias("misses"), F.count_if(~hit & forecast).alias("false_alarms"), F.count_if(~hit & ~forecast).alias("correct_nulls")
    )


def scores(table: DataFrame, least_hit_rate: float = 0.66) -> DataFrame:
    """TSS, CSI, HSS, POD, FAR and bias; undefined ones are null, HSS is 0 unless the hit rate exceeds its limit."""
    h, m, f, c = (F.col(x).cast("double") for x in ("hits", "misses", "false_alarms", "correct_nulls"))
    over = lambda a, b: F.when(b != 0, a / b)
    pod = over(h, h + m)
    hss = over(2 * (h * c - f * m), (h + m) * (m + c) + (h + f) * (f + c))
    return table.withColumns({"pod": pod, "far": over(f, h + f), "bias": over(h + f, h + m), "csi": over(h, h + m + f), "tss": pod - over(f, f + c), "hss": F.when(pod > least_hit_rate, hss).otherwise(0.0)})


def auc(df: DataFrame, keys: Sequence[str], event: str, value: str, weight: str | None = None, orient: str | None = None, sketch: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks: rows meet by value first, so only distinct values are ordered. Nulls go.

    orient "mean" turns a predictor round whose mean is lower in events than in non-events; "max" takes the larger area. sketch: rows with
    the value that are cheaper to read than df.
    """
    w = F.col(weight) if weight else F.lit(1)
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.when(F.col(event) == 1, w).otherwise(0)).alias("__p"), F.sum(F.when(F.col(event) == 0, w).otherwise(0)).alias("__n"))
    return _areas(by, keys, value, {"": "__n"}, orient, df if sketch is None else sketch).select(*keys, F.col("s.auc").alias("auc"), F.col("s.events").alias("events"), F.col("s.nulls").alias("nulls"))


def _areas(by: DataFrame, keys: Sequence[str], value: str, sets: Mapping[str, str], orient: str | None, sketch: DataFrame) -> DataFrame:
    """(keys, s), s being (null_set, auc, events, nulls) of each of sets {name: its column of counts of non-events}, from rows of keys and value with
    their events __p.

    Each range adds up what it holds; then only ranges' totals, as many as keys and ranges, are carried on, and no row is read again.
    """
    dealt, x, counts = with_ranges(by, value, sketch), F.col(value).cast("double"), list(sets.values())
    within = Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    pairs = dealt.withColumns({f"__u{n}": F.col("__p") * (F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(n) / 2) for n in counts})
    sums = [F.sum(c).alias(c) for c in ["__p", *counts, *[f"__u{n}" for n in counts]]] + [F.sum(x * F.col(c)).alias(f"__x{c}") for c in ["__p", *counts]]
    totals = pairs.groupBy(*keys, RANGE).agg(*sums)
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = totals.withColumns({f"__u{n}": F.col(f"__u{n}") + F.col("__p") * F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in counts})
    p, found = F.sum("__p"), []
    for name, column in sets.items():
        n = F.sum(column)
        area = F.when((p > 0) & (n > 0), F.sum(f"__u{column}") / (p * n))
        if orient == "mean":
            area = F.when(F.sum("__x__p") / F.nullif(p, F.lit(0)) < F.sum(f"__x{column}") / F.nullif(n, F.lit(0)), 1 - area).otherwise(area)
        elif orient == "max":
            area = F.greatest(area, 1 - area)
        found.append(F.struct(F.lit(name).alias("null_set"), area.alias("auc"), p.alias("events"), n.alias("nulls")))
    return whole.groupBy(*keys).agg(F.array(*found).alias("s")).select(*keys, F.explode("s").alias("s"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], event: str, value: str, steps: int, top: float | None = None, weight: str | None = None, at_least: bool = False) -> DataFrame:
    """Contingency at `steps` even thresholds 0 ... top for '>': each row is binned once, then counts run downwards.

    Threshold k is k * top / (steps - 1) as the machine works it out; a division finds a row's place to within one, and the thresholds at and
    above it settle it, so values equal to a threshold never exceed it; with at_least they reach it, and '>=' counts.

    Without a top, it is the events' largest value, for each key; keys without events go. A top of 0 makes all thresholds 0.
    """
    if top is None:
        tops = df.where(F.col(event) == 1).groupBy(*keys).agg(F.max(value).cast("double").alias("__top")).where("__top is not null")
        df = df.join(tops, list(keys)) if keys else df.join(F.broadcast(tops))  # one row without keys
        keys = [*keys, "__top"]
    else:
        df, keys = df.withColumn("__top", F.lit(float(top))), [*keys, "__top"]
    x, limit = F.col(value), F.col("__top")
    w = F.col(weight) if weight else F.lit(1)
    at = lambda k: k * limit / (steps - 1)
    near = F.least(F.greatest(F.floor(x * (steps - 1) / F.nullif(limit, F.lit(0.0))), F.lit(0)), F.lit(steps - 1))
    over = lambda t: x >= t if at_least else x > t
    above = F.when(over(at(near + 1)), near + 1).when(over(at(near)), near).when(over(at(near - 1)), near - 1).otherwise(near - 2)  # the last threshold below x
    slot = F.when(limit > 0, F.least(F.greatest(above, F.lit(-1)), F.lit(steps - 1))).otherwise(F.when(over(F.lit(0.0)), steps - 1).otherwise(-1)).cast("int")
    binned = df.groupBy(*keys, slot.alias("__slot")).agg(F.sum(F.when(F.col(event) == 1, w).otherwise(0)).alias("__p"), F.sum(F.when(F.col(event) == 0, w).otherwise(0)).alias("__n"))
    down, every = Window.partitionBy(*keys).orderBy(F.desc("__slot")), Window.partitionBy(*keys)
    upto, past = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    ran = binned.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in ("__p", "__n")} | {f"{c}_past": F.coalesce(F.sum(c).over(past), F.lit(0)) for c in ("__p", "__n")} | {"__ap": F.sum("__p").over(every), "__an": F.sum("__n").over(every)})
    # A slot that no row is in counts what lies above it: each row covers the slots up to the next one, the lowest also those below it.
    covers = F.sequence(F.when(F.lead("__slot").over(down).isNull(), -1).otherwise(F.col("__slot")), F.coalesce(F.lag("__slot").over(down), F.lit(steps)) - 1)
    full = ran.withColumn("__covers", covers).withColumnRenamed("__slot", "__own").withColumn("__slot", F.explode("__covers"))
    of = lambda c: F.when(F.col("__slot") <= F.col("__own"), F.col(f"{c}_upto")).otherwise(F.col(f"{c}_past"))
    out = full.withColumns({"hits": of("__p"), "false_alarms": of("__n")}).where("__slot >= 0")
    return out.select(*keys[:-1], (F.col("__slot") * limit / (steps - 1)).alias("threshold"), F.col("__slot").alias("step"), "hits", (F.col("__ap") - F.col("hits")).alias("misses"), "false_alarms", (F.col("__an") - F.col("false_alarms")).alias("correct_nulls"))


def best_threshold(swept: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, score, best, step, threshold): each score's best value over a sweep, and the first threshold that attains it (to ten digits)."""
    tall = swept.unpivot([*keys, "step", "threshold"], list(names), "score", "best").where("best is not null")
    first = tall.groupBy(*keys, "score").agg(F.max(F.struct(F.round("best", 10).alias("best"), (-F.col("step")).alias("back"), "threshold")).alias("x"))
    return first.select(*keys, "score", F.col("x.best").alias("best"), (-F.col("x.back")).alias("step"), F.col("x.threshold").alias("threshold"))


def ks_two_sample(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """Largest difference of the two groups' distribution functions, and its asymptotic p; rows meet by value first."""
    by = df.groupBy(*keys, value).agg(F.count_if(group).alias("__a"), F.count_if(~group).alias("__b"))
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    ran = running_totals(by.where(F.col(value).isNotNull()), keys, [value], ["__a", "__b"], sketch=df)
    found = ran.groupBy(*keys, "all___a", "all___b").agg(F.max(F.abs(share("__a") - share("__b"))).alias("distance"))
    a, b = F.col("all___a"), F.col("all___b")
    return found.select(*keys, "distance", kolmogorov_p(F.col("distance"), a * b / F.nullif(a + b, F.lit(0))).alias("p"))


def kolmogorov_p(distance: Column, size: Column, terms: int = 100) -> Column:
    """Chance of a larger distance by the limiting distribution, for an effective number of rows; the series is 1 for small arguments."""
    z = distance * F.sqrt(size)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def auc_many(df: DataFrame, names: Sequence[str], event: str, strata: Sequence[Column], null_sets: Mapping[str, Column], orient: str | None = "mean") -> DataFrame:
    """(stratum, null_set, predictor, auc, events, nulls) of all predictors in all strata against all sets of non-events, in one pass.

    A row stands in each of its strata (names; null: in none there) and its event in every null set, a non-event in those whose condition it
    fulfils. Equal values meet before they are copied to strata; sets are columns of counts. Sets that nothing of a stratum stands in have no row.
    """
    marks = [*[c.alias(f"__s{k}") for k, c in enumerate(strata)], *[F.coalesce(c, F.lit(False)).alias(f"__m{k}") for k, c in enumerate(null_sets.values())]]
    own = df.select(event, *marks, *[F.col(n).cast("double").alias(n) for n in names])
    held = [event, *[f"__s{k}" for k in range(len(strata))], *[f"__m{k}" for k in range(len(null_sets))]]
    tall = own.unpivot(held, list(names), "predictor", "x")
    by = tall.groupBy(*held, "predictor", "x").agg(F.count("*").alias("n"))
    each = by.withColumn("stratum", F.explode(F.array_compact(F.array(*[F.col(f"__s{k}") for k in range(len(strata))])))).where("x is not null")
    of = {name: (f"__n{k}", (F.col(event) == 0) & F.col(f"__m{k}")) for k, name in enumerate(null_sets)}
    met = each.groupBy("stratum", "predictor", "x").agg(F.sum(F.when(F.col(event) == 1, F.col("n")).otherwise(0)).alias("__p"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in of.values()])
    found = _areas(met, ["stratum", "predictor"], "x", {name: n for name, (n, _) in of.items()}, orient, tall)
    return found.where("s.events + s.nulls > 0").select("stratum", "s.null_set", "predictor", "s.auc", "s.events", "s.nulls")


def auc_ovr_weighted(df: DataFrame, label: str, value: str, labels: Sequence[int]) -> DataFrame:
    """(auc): the mean area of each label against all others, weighted by the label's rows."""
    each = df.where(F.col(label).isNotNull()).select(F.explode(F.array(*map(F.lit, labels))).alias("__k"), label, value).withColumn("__y", (F.col(label) == F.col("__k")).cast("int"))
    a = auc(each, ["__k"], "__y", value, sketch=df)
    return a.agg((F.sum(F.col("auc") * F.col("events")) / F.sum("events")).alias("auc"))


def ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """df with rank_desc, the row's place from the largest value, and p, the empirical chance of non-exceedance, among the rows of its keys (none: all
    rows). Equal values are ordered by tie, upwards in both. Ranks are running counts over ranges of values; nulls have none."""
    own = df.where(F.col(value).isNotNull())
    by = own.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(by, keys, [value], ["__n"], sketch=df)
    met = ran.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), "__n", "before___n", "all___n")
    same = F.col(value) == F.col("__v")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    place = F.row_number().over(Window.partitionBy(*keys, value).orderBy(tie)).cast("long")
    at = own.withColumn("__place", place).join(met, same)
    down = F.col("all___n") - F.col("before___n") - F.col("__n") + F.col("__place")
    return at.withColumns({"rank_desc": down, "p": (F.col("before___n") + F.col("__place")) / (F.col("all___n") + 1)}).drop("__place", "__n", "before___n", "all___n", "__v", *[f"__k{i}" for i in range(len(keys))])


def expon_fit(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, loc, scale): the exponential distribution of each key's values, its least one and their mean above it; rows may have a weight."""
    x = F.col(value)
    mean = F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight))) if weight else F.avg(x)
    return df.groupBy(*keys).agg(F.min(x).alias("loc"), (mean - F.min(x)).alias("scale"))


def expon_level(loc: Column, scale: Column, chance: float) -> Column:
    """The value that an exponential distribution exceeds with the given chance."""
    return loc - scale * F.log(F.lit(chance))


def ks_one_sample(df: DataFrame, keys: Sequence[str], value: str, fit: DataFrame, cdf: Column) -> DataFrame:
    """(keys, distance): largest gap between each key's values and the distribution function `cdf`, of the value and the columns of fit (a row a key)."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ran = running_totals(by, keys, [value], ["__c"], sketch=df)
    e = ran.join(fit, list(keys)) if keys else ran.join(F.broadcast(fit))  # one row without keys
    upto = lambda more: (F.col("before___c") + more) / F.col("all___c")
    return e.groupBy(*keys).agg(F.max(F.greatest(F.abs(upto(F.col("__c")) - cdf), F.abs(upto(F.lit(0)) - cdf))).alias("distance"))
