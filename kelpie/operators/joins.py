"""Joins that one equality doesn't express: intervals, as-of, merges of candidates, change classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.series import so_far


def attribute_to_intervals(
    events: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: Column, event_id: str, take: str, bucket_hours: int = 12
) -> DataFrame:
    """(event_id, take): for each event the interval of its key that holds it and started last.

    Both ends are inclusive, compared in whole seconds; ties go to the greatest `take`. Intervals are
    spread over the time buckets they touch, so the join is an equality on key and bucket and a hot key
    is cut into its buckets. Events in no interval have no row. An interval must be bounded: a null end
    has to be capped by the caller, else it holds nothing.
    """
    width = bucket_hours * 3600
    second = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    spans = intervals.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], second(F.col(start)).alias("_from"), second(end).alias("_to"), F.col(take).alias("_take")
    ).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    points = events.select(event_id, *key, second(F.col(at)).alias("_at")).withColumn("_bucket", F.floor(F.col("_at") / width))
    on = F.col("_at").between(F.col("_from"), F.col("_to"))
    equal = [points["_bucket"] == spans["_bucket"], *[points[k].eqNullSafe(spans[f"_k_{k}"]) for k in key]]
    for condition in equal:
        on = on & condition
    return points.join(spans, on).groupBy(event_id).agg(F.max(F.struct("_from", "_take"))["_take"].alias(take))


def next_at_or_after(points: DataFrame, marks: DataFrame, key: str, x: str, mark_x: str, mark_id: str, rank: str) -> DataFrame:
    """(mark_id, rank): for each mark the first point at or after it, else the key's last point.

    The marks are put among the points, from the last to the first, and the least rank so far is the
    answer; nothing is paired and no key is sorted in one place.
    """
    both = points.select(key, F.col(x).alias("_x"), F.lit(1).alias("_kind"), F.col(rank).alias("_rank"), F.lit(None).cast("long").alias(mark_id)).unionByName(
        marks.select(key, F.col(mark_x).alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_rank"), F.col(mark_id))
    )
    order = [-F.col("_x"), -F.col("_kind"), -F.col("_rank"), F.col(mark_id)]
    found = so_far(both, key, order, {"_near": ("min", F.col("_rank"))}, {"_last": ("max", F.col("_rank"))})
    answer = found.where("_kind = 0").select(mark_id, F.coalesce("_near", "_last").alias(rank))
    return answer.where(F.col(rank).isNotNull())


def change_classes(now: DataFrame, before: DataFrame, key: str, content: str, stamp: str) -> DataFrame:
    """(key, change) of a tree against its index: new, unchanged, touched (same content), changed, deleted."""
    joined = now.select(key, F.col(content).alias("_c"), F.col(stamp).alias("_s"), F.lit(True).alias("_now")).join(
        before.select(key, F.col(content).alias("_bc"), F.col(stamp).alias("_bs"), F.lit(True).alias("_was")), key, "full_outer"
    )
    change = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_now").isNull(), "deleted")
        .when(F.col("_s").eqNullSafe(F.col("_bs")), "unchanged")
        .when(F.col("_c").eqNullSafe(F.col("_bc")), "touched")
        .otherwise("changed")
    )
    return joined.select(key, change.alias("change"))


def hash_status(sources: DataFrame, stored: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """(key, status): missing, current or drifted, by the digest of the present text against the stored one."""
    right = stored.select(F.col(key).alias("_key"), F.col(digest).alias("_stored"))
    joined = sources.join(right, F.col(key) == F.col("_key"), "left")
    now = F.sha2(F.encode(F.col(text), "UTF-8"), 256)
    status = F.when(F.col("_key").isNull(), "missing").when(F.col("_stored").eqNullSafe(now), "current").otherwise("drifted")
    return joined.select(key, status.alias("status"))


def by_id_or_key(table: DataFrame, wanted: str, id_column: str, key_column: str) -> DataFrame:
    """The one row whose id is `wanted`, else the one whose key is; no row if neither."""
    rank = F.when(F.col(id_column).cast("string") == wanted, 0).otherwise(1)
    hits = table.where((F.col(id_column).cast("string") == wanted) | (F.col(key_column).cast("string") == wanted))
    return hits.orderBy(rank, id_column).limit(1)
