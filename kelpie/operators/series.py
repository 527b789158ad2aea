"""Series: running totals, strictly increasing positions, medians, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICES = 256  # ranges of the order into which every group is cut
_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def _united(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return {"max": F.greatest, "min": F.least, "last": lambda b, h: F.coalesce(h, b)}[kind](before, here)


Bounds = tuple[float | None, float | None]


def bounds_of(df: DataFrame, order: Column) -> Bounds:
    """The least and the greatest value of an order, as numbers."""
    at = order.cast("double")
    return tuple(df.agg(F.min(at), F.max(at)).first())


def sliced(df: DataFrame, order: Column, slices: int = SLICES, bounds: Bounds | None = None) -> DataFrame:
    """`df` with `_slice`: which of so many equal ranges of the order (a number or an instant) a row is in; nulls come first."""
    low, high = bounds or bounds_of(df, order)
    if low is None or high == low:
        return df.withColumn("_slice", F.when(order.isNull(), F.lit(-1)).otherwise(F.lit(0)))
    place = F.least(F.floor((order.cast("double") - F.lit(low)) * F.lit(slices / (high - low))), F.lit(slices - 1))
    return df.withColumn("_slice", F.coalesce(place, F.lit(-1)).cast("int"))


def so_far(
    df: DataFrame, group: str, order: list[Column], parts: dict[str, tuple[str, Column]], whole: dict[str, tuple[str, Column]] | None = None, bounds: Bounds | None = None
) -> DataFrame:
    """Adds the sum, max, min or last value that isn't null of an expression over a group's rows up to each row.

    No group is sorted in one place: it is cut into slices of its order, each is summed up by itself, and
    only the slices' totals, `SLICES` a group, are put in a row. `whole` adds aggregates over the group.
    The order's first column is a number or an instant, its `bounds` are looked up where they aren't
    given; the order must be total.
    """
    keyed = sliced(df, order[0], bounds=bounds).withColumn("_g", F.struct(group))  # a null is a group, too
    inside = Window.partitionBy("_g", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = {**parts, **{f"_w_{n}": p for n, p in (whole or {}).items()}}
    columns = keyed.withColumns({f"_v_{n}": value for n, (_, value) in every.items()})
    newest = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    totals = columns.groupBy("_g", "_slice").agg(
        *[(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), newest)) if kind == "last" else _TOTAL[kind](f"_v_{n}")).alias(f"_t_{n}") for n, (kind, _) in every.items()]
    )
    before = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows
    all_of = Window.partitionBy("_g")
    over = lambda n, kind: (F.last(f"_t_{n}", ignorenulls=True) if kind == "last" else _TOTAL[kind](f"_t_{n}")).over(before)
    starts = totals.select(
        "_g", "_slice", *[over(n, kind).alias(f"_s_{n}") for n, (kind, _) in parts.items()], *[_TOTAL[kind](f"_t__w_{n}").over(all_of).alias(n) for n, (kind, _) in (whole or {}).items()]
    )
    here = lambda n, kind: (F.last(f"_v_{n}", ignorenulls=True) if kind == "last" else _TOTAL[kind](f"_v_{n}")).over(inside)
    local = columns.withColumns({f"_h_{n}": here(n, kind) for n, (kind, _) in parts.items()})
    joined = local.join(starts, ["_g", "_slice"])
    out = {n: _united(kind, F.col(f"_s_{n}"), F.col(f"_h_{n}")) for n, (kind, _) in parts.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()], *(whole or {}))


def running_total(df: DataFrame, group: str, order: list[str], amounts: list[str]) -> DataFrame:
    """`total_<amount>` over the rows of a group so far; negatives count as 0, nulls too."""
    return so_far(df, group, [F.col(o) for o in order], {f"total_{a}": ("sum", F.greatest(F.coalesce(F.col(a), F.lit(0)), F.lit(0))) for a in amounts})


def strictly_increasing(df: DataFrame, group: str, order: list[str], x: str, out: str = "x_strict") -> DataFrame:
    """Positions nudged so that each is greater than the one before: ties by one, nulls one after the last.

    Closed form: i + max over the rows so far of (x - i). A leading null has no position to follow and
    stays null.
    """
    ordered = [F.col(o) for o in order]
    bounds = bounds_of(df, ordered[0])
    numbered = so_far(df, group, ordered, {"_i": ("sum", F.lit(1).cast("long"))}, bounds=bounds)
    lifted = so_far(numbered, group, ordered, {"_lift": ("max", F.col(x) - F.col("_i"))}, bounds=bounds)
    return lifted.withColumn(out, F.col("_i") + F.col("_lift")).drop("_i", "_lift")


def first_qualifying(df: DataFrame, group: str, order: list[str], condition: Column, amount: str, out: str) -> DataFrame:
    """The amount on a group's first row that meets the condition, 0 on all others."""
    counted = so_far(df, group, [F.col(o) for o in order], {"_nth": ("sum", F.when(condition, 1).otherwise(0))})
    return counted.withColumn(out, F.when(condition & (F.col("_nth") == 1), F.col(amount)).otherwise(F.lit(0))).drop("_nth")


def turn_series(turns: DataFrame, group: str, order: str, x: str, amount: str, qualifies: Column, spared: str) -> DataFrame:
    """`turns` with the running total of an amount, strictly increasing positions and the counterfactual: the
    running total of what the first qualifying turn of a group spared. Two passes for all of them."""
    ordered, bounds = [F.col(order)], bounds_of(turns, F.col(order))
    positive = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    first = {"_i": ("sum", F.lit(1).cast("long")), "_nth": ("sum", F.when(qualifies, 1).otherwise(0)), f"total_{amount}": ("sum", positive(F.col(amount)))}
    numbered = so_far(turns, group, ordered, first, bounds=bounds)
    offset = F.when(qualifies & (F.col("_nth") == 1), positive(F.col(spared))).otherwise(F.lit(0))
    second = so_far(numbered, group, ordered, {"_lift": ("max", F.col(x) - F.col("_i")), "counterfactual": ("sum", offset)}, bounds=bounds)
    return second.withColumn("x_strict", F.col("_i") + F.col("_lift")).drop("_i", "_nth", "_lift")


def latest_per(df: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row per group in a total order, as an aggregate: no group is sorted."""
    last = F.max(F.struct(*order, *[k for k in keep if k not in order])).alias("_last")
    return df.groupBy(*group).agg(last).select(*group, *[F.col(f"_last.{k}").alias(k) for k in keep])


def median_integer(value: Column) -> Column:
    """Exact median; for an even number the mean of the two middle values, cut toward 0."""
    return F.percentile(value, F.lit(0.5)).cast("long")


def carry_forward(df: DataFrame, group: str, order: list[str], column: str, out: str) -> DataFrame:
    """The last value that isn't null so far."""
    return so_far(df, group, [F.col(o) for o in order], {out: ("last", F.col(column))})
