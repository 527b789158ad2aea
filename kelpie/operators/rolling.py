"""Rolling totals over trailing periods (problem 5).

Method: event-contribution deltas. The amount of a day adds at that day and subtracts where it leaves
a window, `days` later; the running sum of the deltas is the trailing total, whatever the gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str, keep: list[str]) -> DataFrame:
    """One row per `key`: the one with the greatest `version` (null lowest).

    Ties are settled by the kept columns in their order, so repeated rows give one defined result. A
    null key is a key of its own. Structs compare field by field and nulls first; the maximum is
    combined before the shuffle, so a key with a third of all rows is no hot spot.
    """
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in keep])).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col("_best")[c].alias(c) for c in keep])


def daily_amounts(df: DataFrame, key: str, day: Column, measures: dict[str, Column]) -> DataFrame:
    """Sums per key and day; rows without a day don't count, null amounts count as 0."""
    sums = [F.sum(F.coalesce(amount, F.lit(0)).cast("long")).alias(name) for name, amount in measures.items()]
    return df.withColumn("_day", day).where(F.col("_day").isNotNull()).groupBy(key, F.col("_day").alias("day")).agg(*sums)


def change_points(daily: DataFrame, key: str, measures: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Trailing totals at every day where one changes, and the day before the next change.

    Columns: key, day, until (null at the last one), total_<w>d_<measure>. Each daily row becomes one
    delta per window end plus one at its own day; after the sum per day the rows of a key are bounded
    by the days of the calendar, so the window needs no salt.
    """
    moves = F.array(
        F.struct(F.col("day").alias("at"), *[F.col(m).alias(f"d{w}_{m}") for w in windows for m in measures]),
        *[
            F.struct(
                F.date_add("day", end).alias("at"),
                *[(-F.col(m) if w == end else F.lit(0).cast("long")).alias(f"d{w}_{m}") for w in windows for m in measures],
            )
            for end in windows
        ],
    )
    names = [f"d{w}_{m}" for w in windows for m in measures]
    deltas = (
        daily.select(key, F.explode(moves).alias("m"))
        .groupBy(key, F.col("m.at").alias("day"))
        .agg(*[F.sum(f"m.{n}").alias(n) for n in names])
    )
    order = Window.partitionBy(key).orderBy("day")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(f"d{w}_{m}").over(running).alias(f"total_{w}d_{m}") for w in windows for m in measures]
    return deltas.select(key, "day", F.date_sub(F.lead("day").over(order), 1).alias("until"), *totals)


def rolling_totals(
    daily: DataFrame, key: str, measures: list[str], windows: tuple[int, ...] = (7, 30), means: list[str] | None = None
) -> DataFrame:
    """Totals of the trailing windows for each key and day, days without activity included.

    A key's days run from its first active day to the last day on which a window still holds
    something; later days are zero throughout and have no row. Columns: key, day,
    total_<w>d_<measure>, and mean_<w>d_<measure> for `means` (default: all measures).
    """
    points = change_points(daily, key, measures, windows)
    dense = points.withColumn("day", F.explode(F.sequence("day", F.coalesce("until", "day"))))
    averages = [
        (F.col(f"total_{w}d_{m}") / F.lit(float(w))).alias(f"mean_{w}d_{m}")
        for w in windows
        for m in (measures if means is None else means)
    ]
    alive = F.lit(False)
    for w in windows:
        for m in measures:
            alive = alive | (F.col(f"total_{w}d_{m}") != 0)
    return dense.where(F.col("until").isNotNull() | alive).select(
        key, "day", *[f"total_{w}d_{m}" for w in windows for m in measures], *averages
    )


def session_days(sessions: DataFrame) -> DataFrame:
    """Per project and UTC day of ended_at: sessions, input and output tokens, each session once."""
    kept = latest_rows(
        sessions.select("session_id", "project_id", "ended_at", "input_tokens", "output_tokens", "last_scanned_offset"),
        "session_id",
        "last_scanned_offset",
        ["ended_at", "project_id", "input_tokens", "output_tokens"],
    )
    return daily_amounts(
        kept,
        "project_id",
        F.to_date("ended_at"),
        {"sessions": F.lit(1), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens")},
    )


MEASURES = ["sessions", "input_tokens", "output_tokens"]


def wrong_reports(reports: DataFrame, sessions: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """report_id of each report with a figure that the sessions don't give; a null figure is wrong too.

    Reports of a day or project outside the sessions are held against zeros.
    """
    totals = rolling_totals(session_days(sessions), "project_id", MEASURES).withColumnsRenamed({"project_id": "_project", "day": "_day"})
    joined = reports.join(totals, F.col("project_id").eqNullSafe(F.col("_project")) & (F.col("report_day") == F.col("_day")), "left")
    wrong = F.lit(False)
    for w in (7, 30):
        for m in MEASURES:
            wrong = wrong | ~F.col(f"totals_{w}d_{m}").eqNullSafe(F.coalesce(F.col(f"total_{w}d_{m}"), F.lit(0)))
        gap = F.abs(F.col(f"avg_{w}d_input_tokens") - F.coalesce(F.col(f"mean_{w}d_input_tokens"), F.lit(0.0)))
        wrong = wrong | F.coalesce(gap > tolerance, F.lit(True))
    return joined.where(wrong).select("report_id").distinct()
