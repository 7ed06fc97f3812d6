"""Drawn samples: numbers that follow from counters alone, bootstrap weights of counts, draws with replacement.

Numbers come from integer arithmetic below 2**63, so every engine finds the same ones; their SQL stands beside them, for checks in other engines.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeworks.operators import skill as K
from galeworks.operators.ordered import running_totals

#: Numbers are taken modulo this prime; as 5 has no factor in common with it less 1, a fifth power changes the numbers' order only.
PRIME = (1 << 31) - 1
#: Poisson means up to this one are drawn by the exact distribution, by TERMS of it; above it a normal number, skewed as Poisson's, is rounded.
EXACT_MEAN, TERMS = 4, 18


def _mixed(x: str, seed: str) -> str:
    """One round, as SQL: the fifth power of the sum."""
    y = f"(({x} + {seed} % {PRIME} + 1) % {PRIME})"
    return f"(({y} * {y} % {PRIME}) * ({y} * {y} % {PRIME})) % {PRIME} * {y} % {PRIME}"


def hashed(*seeds: str) -> str:
    """Spark SQL of an even number in 0 ... PRIME - 1 that follows from the seeds, whole numbers from 0 on, a round for each and one for their number."""
    each = ", ".join(f"CAST({s} AS BIGINT)" for s in [*seeds, len(seeds)])
    return f"aggregate(array({each}), CAST(0 AS BIGINT), (x, s) -> {_mixed('x', 's')})"


def with_round(df: DataFrame, name: str, seed: Column) -> DataFrame:
    """df with column `name` after one round of `hashed` with the seed. A step a column, so that none is worked out more than once."""
    x = F.col(name)
    df = df.withColumn(name, (x + seed.cast("long") % PRIME + 1) % PRIME).withColumn("__x2", x * x % PRIME).withColumn("__x4", F.col("__x2") * F.col("__x2") % PRIME)
    return df.withColumn(name, F.col("__x4") * x % PRIME).drop("__x2", "__x4")


def poisson_bounds(mean: float) -> list[int]:
    """The hashes from which on a Poisson number of a mean up to EXACT_MEAN is at least 1, 2, ..., as `_poisson` draws it."""
    found = []
    for k in range(TERMS):
        total = 1.0
        for j in range(k, 0, -1):
            total = 1.0 + mean / j * total
        low, high = 0, PRIME  # u * exp(mean) rises with the hash
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if (middle + 0.5) / PRIME * math.exp(mean) >= total else (middle + 1, high)
        if low < PRIME:
            found.append(low)
    return found


def sql_hashed(*seeds: str) -> str:
    """The same for DuckDB."""
    each = ", ".join(f"CAST({s} AS BIGINT)" for s in ["0", *seeds, len(seeds)])
    return f"list_reduce([{each}], lambda x, s: {_mixed('x', 's')})"


def _poisson(u: str, v: str, mean: str) -> str:
    """A Poisson number of the given mean from even numbers u and v in (0, 1), as SQL that all engines read."""
    sums = []
    for k in range(TERMS):
        text = "1.0"
        for j in range(k, 0, -1):  # the first k + 1 terms of exp(mean): 1 + mean/1 (1 + mean/2 (1 + ...))
            text = f"(1.0 + {mean} / {j}.0 * {text})"
        sums.append(f"(CASE WHEN {u} * exp({mean}) >= {text} THEN 1 ELSE 0 END)")
    z = f"(sqrt(-2.0 * ln({u})) * cos(6.283185307179586 * {v}))"
    large = f"greatest(floor({mean} + sqrt({mean}) * {z} + ({z} * {z} - 1.0) / 6.0 + 0.5), 0.0)"
    return f"CAST(CASE WHEN {mean} <= {EXACT_MEAN} THEN {' + '.join(sums)} ELSE {large} END AS BIGINT)"


def drawn_counts(counts: DataFrame, columns: Mapping[str, tuple[str, float]], seeds: Sequence[str], replicates: int) -> DataFrame:
    """counts once per replicate, with a drawn count for each of columns {name: (count, share)}: Poisson with the mean count * share.

    That is the sum of the bootstrap weights of so many rows, so equal rows are drawn as one, and the cost follows from the distinct rows
    whatever their number. The seeds (columns or SQL, whole numbers from 0 on) name a row of counts. What is not drawn at all in a replicate is
    left out before rows are copied. Counts are few rows with much to draw each, so they are dealt out evenly first.
    """
    fields = []
    for k, (name, (count, share)) in enumerate(columns.items()):
        h = hashed(*seeds, "r", str(2 * k))
        uv = f"transform(array({h}), h -> named_struct('u', (h + 0.5D) / {PRIME}, 'v', ({hashed('h', str(2 * k + 1))} + 0.5D) / {PRIME}, 'm', CAST({count} AS DOUBLE) * {share!r}D))"
        fields.append(f"'{name}', transform({uv}, z -> {_poisson('z.u', 'z.v', 'z.m')})[0]")
    each = f"transform(sequence(0, {replicates - 1}), r -> named_struct('replicate', r, {', '.join(fields)}))"
    some = " or ".join(f"d.{name} > 0" for name in columns)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = counts.repartition(parts).withColumn("__d", F.expr(f"explode(filter({each}, d -> {some}))"))
    return out.withColumns({"replicate": F.col("__d.replicate")} | {name: F.col(f"__d.{name}") for name in columns}).drop("__d")


def sql_drawn(source: str, columns: Mapping[str, tuple[str, float]], seeds: Sequence[str], replicates: int, out: str) -> str:
    """CTEs that give `drawn_counts` as the table `out` over the table `source`, for DuckDB."""
    first = ", ".join(f"{sql_hashed(*seeds, 'replicate', str(2 * k))} AS a{k}" for k in range(len(columns)))
    second = ", ".join(f"(a{k} + 0.5) / {PRIME} AS u{k}, ({sql_hashed(f'a{k}', str(2 * k + 1))} + 0.5) / {PRIME} AS v{k}, {count} * CAST({share!r} AS DOUBLE) AS m{k}" for k, (count, share) in enumerate(columns.values()))
    third = ", ".join(f"{_poisson(f'u{k}', f'v{k}', f'm{k}')} AS {name}" for k, name in enumerate(columns))
    some = " OR ".join(f"{name} > 0" for name in columns)
    return (
        f"{out}_a AS MATERIALIZED (SELECT *, {first} FROM {source}, range({replicates}) AS r(replicate)), {out}_u AS MATERIALIZED (SELECT *, {second} FROM {out}_a), "
        f"{out}_d AS MATERIALIZED (SELECT *, {third} FROM {out}_u), {out} AS MATERIALIZED (SELECT * FROM {out}_d WHERE {some})"
    )


def bootstrap_skill(df: DataFrame, keys: Sequence[str], event: str, value: str, seeds: Sequence[str], replicates: int = 1000, null_share: float = 1.0, metric: str = "auc", steps: int = 100, orient: str | None = "mean") -> DataFrame:
    """(keys, replicate, score, threshold): a predictor's skill over bootstrap replicates of events and non-events, drawn apart within each key.

    Rows meet by value first; counts are then drawn (drawn_counts), non-events with null_share of their number. "auc" is the area under the curve,
    turned round in replicates whose events have the lower mean (by orient), and has no threshold; "tss", "csi" and "hss" are the best over `steps`
    even thresholds from 0 to the replicate's largest event, with the first threshold that attains it. The seeds, whole
    numbers from 0 on, name a row of keys and value. Replicates without events or non-events have no score.
    """
    met = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(event) == 1).alias("__p"), F.count_if(F.col(event) == 0).alias("__n"))
    drawn = drawn_counts(met, {"__dp": ("__p", 1.0), "__dn": ("__n", null_share)}, seeds, replicates)
    sides = F.explode(F.array(F.struct(F.lit(1).alias("e"), F.col("__dp").alias("w")), F.struct(F.lit(0).alias("e"), F.col("__dn").alias("w"))))
    each = drawn.select(*keys, "replicate", value, sides.alias("s")).select(*keys, "replicate", value, F.col("s.e").alias("__event"), F.col("s.w").alias("__weight")).where("__weight > 0")
    by = [*keys, "replicate"]
    if metric == "auc":
        return K.auc(each, by, "__event", value, "__weight", orient=orient, sketch=met).select(*by, F.col("auc").alias("score"), F.lit(None).cast("double").alias("threshold"))
    swept = K.scores(K.threshold_sweep(each, by, "__event", value, steps, weight="__weight"))
    return K.best_threshold(swept, by, [metric]).select(*by, F.col("best").alias("score"), "threshold")


def resample_events(df: DataFrame, row: Sequence[str], event: str, replicates: int, size: int, share: float | None = None) -> DataFrame:
    """For each replicate `size` events drawn with replacement, and non-events: as many as keep the classes' proportion, or the given share of all.

    Rows of a class are numbered in the order of `row` (which names each row), by running counts over ranges; a draw is a number that follows from
    replicate and turn, and meets the row of that number. Adds `replicate`; a row stands as often as it is drawn.
    """
    own = df.where(F.col(event).isin(0, 1))
    n = own.agg(F.count_if(F.col(event) == 1).alias("p"), F.count_if(F.col(event) == 0).alias("n")).first()
    ratio = round((n.p + n.n) / n.p) if n.p else 0
    nulls = size * ratio if share is None else round(n.n * share)
    numbered = running_totals(own.withColumn("__one", F.lit(1)), [event], list(row), ["__one"]).withColumnRenamed("before___one", "__at").drop("__one", "all___one")
    drawn = None
    for side, turns, have in ((1, size, n.p), (0, nulls, n.n)):
        if not (turns and have):
            continue
        of = df.sparkSession.range(replicates * turns).select(F.lit(side).alias("__side"), F.floor(F.col("id") / turns).cast("int").alias("replicate"), (F.col("id") % turns).alias("__turn"), F.lit(0).cast("long").alias("__h"))
        for seed in (F.lit(side), F.col("replicate"), F.col("__turn"), F.lit(3)):  # as hashed(side, replicate, __turn)
            of = with_round(of, "__h", seed)
        # Exploded, as the join asks for known numbers, and Spark would push that through the rounds and write each of them out five times over.
        one = of.select("__side", "replicate", F.explode(F.array(F.col("__h") % have)).alias("__of"))
        drawn = one if drawn is None else drawn.unionByName(one)
    if drawn is None:
        return df.where("false").withColumn("replicate", F.lit(0))
    return drawn.join(numbered, (F.col("__side") == F.col(event)) & (F.col("__of") == F.col("__at"))).drop("__side", "__of", "__at")


def bootstrap_rows(df: DataFrame, row: str, replicates: int) -> DataFrame:
    """df once per replicate with `weight`, a Poisson number of mean 1 that follows from row, a whole number, and replicate; rows of weight 0 go.

    The same numbers as drawn_counts of counts of one: as the mean is fixed, a weight follows from how many of a few whole numbers the hash reaches. A row's
    own round is done once for all its replicates, and rounds are plain columns, which Spark compiles.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = with_round(df.repartition(parts).withColumn("__h", F.lit(0).cast("long")), "__h", F.col(row))
    each = own.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    for seed in (F.col("replicate"), F.lit(0), F.lit(3)):  # as hashed(row, replicate, 0)
        each = with_round(each, "__h", seed)
    least = poisson_bounds(1.0)
    weight = sum(((F.col("__h") >= b).cast("long") for b in least[1:]), F.lit(1).cast("long"))
    # No filter: Spark would push it through the rounds and write each of them out five times over.
    return each.withColumn("weight", F.explode(F.when(F.col("__h") >= least[0], F.array(weight)))).drop("__h")


def undersample(df: DataFrame, row: Sequence[str], event: str, ratio: float) -> DataFrame:
    """Events, and of the non-events a share that gives `ratio` for each event on average (all of them, if there are fewer).

    Whether a row is drawn follows from `row`, whole numbers from 0 on that name it.
    """
    n = df.agg(F.count_if(F.col(event) == 1).alias("p"), F.count_if(F.col(event) == 0).alias("n")).first()
    share = min(1.0, ratio * n.p / max(n.n, 1))
    return df.where((F.col(event) == 1) | ((F.col(event) == 0) & (F.expr(hashed(*row)) < share * PRIME)))


def holdout_by_year(df: DataFrame, keys: Sequence[str], event: str, value: str, test: Column, seeds: Sequence[str], replicates: int = 1000) -> DataFrame:
    """(keys, trained, auc, low, high): area on the tested rows, turned as the others ask, with its 5 and 95 % over bootstrap replicates of the
    tested rows; trained is the area on the other rows."""
    tested = df.where(test)
    base = K.auc(df.where(~F.coalesce(test, F.lit(False))), keys, event, value)
    turn = lambda c: F.when(F.col("trained") < 0.5, 1 - F.col(c)).otherwise(F.col(c))
    found = K.auc(tested, keys, event, value).select(*keys, "auc").join(base.select(*keys, F.col("auc").alias("trained")), list(keys))
    drawn = bootstrap_skill(tested, keys, event, value, seeds, replicates, orient=None).groupBy(*keys).agg(F.percentile("score", 0.05).alias("__a"), F.percentile("score", 0.95).alias("__b"))
    both = found.join(drawn, list(keys))
    return both.select(*keys, "trained", turn("auc").alias("auc"), F.least(turn("__a"), turn("__b")).alias("low"), F.greatest(turn("__a"), turn("__b")).alias("high"))
