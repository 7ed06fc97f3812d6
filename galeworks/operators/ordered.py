"""Running totals, values carried along an order, ranks and quantiles, in groups of any size: no group is ordered in one task.

Rows are dealt by ranges of the order's first column. The ranges' bounds come from a quantile sketch of that column and stand in the plan as
literals, so a row's range follows from the row alone: nothing is written, and a lost task's rows fall into the same ranges again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The column that holds a row's range; functions use it where it is there, and leave it.
RANGE = "__range"


def _number(df: DataFrame, column: str) -> Column:
    """The column as a number that has its order: times and days as microseconds."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind in ("string", "boolean", "binary") or kind.startswith(("array", "struct", "map")):
        raise ValueError(f"ranges need a number or a time, not {column} ({kind})")
    return F.col(column)


def with_ranges(df: DataFrame, by: str, sketch: DataFrame | None = None, turned: bool = False) -> DataFrame:
    """df with RANGE: the number of the row's range of `by`, from 0 on, rising with `by` (falling if turned); nulls come first (last if turned).

    There are as many ranges as shuffle partitions, with about as many rows of `sketch` in each (rows with `by` that are cheaper to
    read than df, or df itself); rows equal in `by` lie in one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = df if sketch is None else sketch
    shares = [k / parts for k in range(1, parts)]
    found = seen.agg(F.percentile_approx(_number(seen, by), F.array(*map(F.lit, shares)), 100 * parts).alias("q")).first().q if shares else []
    bounds = sorted({b for b in found or [] if b == b})  # a NaN bounds nothing
    x = _number(df, by)

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(high if not turned else len(bounds) - high)
        middle = (low + high + 1) // 2
        return F.when(x < bounds[middle - 1], place(low, middle - 1)).otherwise(place(middle, high))

    return df.withColumn(RANGE, F.when(x.isNull(), len(bounds) if turned else 0).otherwise(place(0, len(bounds))))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the columns of right, which has one row for each keys and RANGE of left; null keys meet."""
    own = right.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, RANGE]})
    same = F.col(RANGE) == F.col(f"__of_{RANGE}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(own, same).drop(*[f"__of_{c}" for c in [*keys, RANGE]])


def _sorted(order: Sequence[str], turned: bool) -> list[Column]:
    return [F.desc(c) if turned else F.asc(c) for c in order]


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], sketch: DataFrame | None = None, turned: bool = False) -> DataFrame:
    """df with before_<v> and all_<v> for each value: its sum over the rows of the same keys that come earlier, and over all of them.

    Ranges add up for themselves and are then shifted by the ranges before, whose totals are as many as keys and ranges. `turned` runs
    from the largest to the least; sketch as in with_ranges.
    """
    dealt = df if RANGE in df.columns else with_ranges(df, order[0], sketch, turned)
    by = Window.partitionBy(*keys)
    earlier = by.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, RANGE).agg(*[F.sum(v).alias(v) for v in values])
    shifts = totals.select(*keys, RANGE, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__shift_{v}") for v in values], *[F.sum(v).over(by).alias(f"all_{v}") for v in values])
    within = Window.partitionBy(*keys, RANGE).orderBy(*_sorted(order, turned)).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"before_{v}") for v in values])
    out = _same(own, shifts, keys).withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"__shift_{v}") for v in values})
    return out.drop(*[f"__shift_{v}" for v in values], *([] if RANGE in df.columns else [RANGE]))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: Mapping[str, Column], ahead: Mapping[str, Column] | None = None, sketch: DataFrame | None = None, final: Mapping[str, Column] | None = None) -> DataFrame:
    """df with a column for each name of `back`: its last value that is not null, at the row or earlier in the order, among rows of the same keys;
    of `ahead`: its first one at the row or later; and of `final`: its last one of all rows of the keys.

    Within a range by a running last value; where none is found there, the last one of the ranges before (after), which are as many as keys
    and ranges. Rows equal in the whole order are taken in any order.
    """
    ahead, final = ahead or {}, final or {}
    dealt = (df if RANGE in df.columns else with_ranges(df, order[0], sketch)).withColumns({f"__in_{n}": c for n, c in [*back.items(), *ahead.items(), *final.items()]})
    by, first, last = Window.partitionBy(*keys).orderBy(RANGE), Window.unboundedPreceding, Window.unboundedFollowing
    known = lambda n: F.when(F.col(f"__in_{n}").isNotNull(), F.struct(*order))
    ends = dealt.groupBy(*keys, RANGE).agg(*[F.max_by(f"__in_{n}", known(n)).alias(f"__end_{n}") for n in [*back, *final]], *[F.min_by(f"__in_{n}", known(n)).alias(f"__end_{n}") for n in ahead])
    other = ends.select(
        *keys, RANGE, *[F.last(f"__end_{n}", True).over(by.rowsBetween(first, -1)).alias(f"__far_{n}") for n in back], *[F.first(f"__end_{n}", True).over(by.rowsBetween(1, last)).alias(f"__far_{n}") for n in ahead], *[F.last(f"__end_{n}", True).over(by.rowsBetween(first, last)).alias(n) for n in final]
    )
    within = Window.partitionBy(*keys, RANGE)
    # What lies ahead is what came last in the turned order: a frame to the end would be read anew for each row.
    up, down = within.orderBy(*order).rowsBetween(first, 0), within.orderBy(*_sorted(order, True)).rowsBetween(first, 0)
    near = dealt.withColumns({n: F.last(f"__in_{n}", True).over(up) for n in back} | {n: F.last(f"__in_{n}", True).over(down) for n in ahead})
    out = _same(near, other, keys).withColumns({n: F.coalesce(n, f"__far_{n}") for n in [*back, *ahead]})
    return out.drop(*[f"__{p}_{n}" for p in ("in", "far") for n in [*back, *ahead, *final]], *([] if RANGE in df.columns else [RANGE]))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, shares: Mapping[str, float]) -> DataFrame:
    """(keys, a column for each name of shares): exact quantiles, linear between ranks; nulls go.

    Rows meet by value first; the ranks that a quantile lies between are looked up in the running counts.
    """
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).alias("__x")).where("__x is not null")
    by = rows.groupBy(*keys, "__x").agg(F.count("*").alias("n"))
    run = running_totals(by, keys, ["__x"], ["n"], sketch=rows)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("__x")))

    found = run.groupBy(*keys, "all_n").agg(*[f(p * (F.col("all_n") - 1)).alias(f"__{side}_{n}") for n, p in shares.items() for side, f in (("a", lambda r: at(F.floor(r))), ("b", lambda r: at(F.ceil(r))))])
    part = lambda p: p * (F.col("all_n") - 1) - F.floor(p * (F.col("all_n") - 1))
    return found.select(*keys, *[(F.col(f"__a_{n}") + part(p) * (F.col(f"__b_{n}") - F.col(f"__a_{n}"))).alias(n) for n, p in shares.items()])
