"""Snapshot DML: each operator takes the table as it is and gives the table as it will be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key, others are added. Keys that repeat in `rows` must not differ.

    Null keys are equal to each other. Only the keys of `rows` are compared with the table.
    """
    incoming = rows.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return table.join(incoming, same, "left_anti").unionByName(rows.distinct())


def upsert_where(table: DataFrame, rows: DataFrame, key: str, at: str, interval: Column) -> DataFrame:
    """Debounced upsert: a row replaces one of its key only if that is older by the interval or has no time."""
    seen = table.select(F.col(key).alias("_k"), F.col(at).alias("_at"))
    due = rows.join(seen, F.col(key).eqNullSafe(F.col("_k")), "left").where(F.col("_at").isNull() | (F.col(at) - F.col("_at") >= interval))
    return upsert(table, due.select(*rows.columns), [key])


def add_up(table: DataFrame, delta: DataFrame, key: list[str], sums: list[str], firsts: list[str], lasts: list[str]) -> DataFrame:
    """Additive upsert: sums of both sides, the earliest of `firsts`, the latest of `lasts`; nulls give way."""
    both = table.unionByName(delta.select(*table.columns))
    return both.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in firsts], *[F.max(c).alias(c) for c in lasts]
    )


def supersede(table: DataFrame, links: DataFrame, key: str, status: str | None = None) -> DataFrame:
    """Links rows to their replacements (key, superseded_by); nothing is deleted, a self-link is refused.

    A row that is linked keeps its old link unless `links` has a new one; with `status`, linked rows
    become 'superseded'. Links from or to rows that don't exist are refused too.
    """
    known = table.select(F.col(key).alias("_target"))
    good = (
        links.where(F.col(key) != F.col("superseded_by"))
        .join(known, F.col("superseded_by") == F.col("_target"), "left_semi")
        .groupBy(F.col(key).alias("_from"))
        .agg(F.max("superseded_by").alias("_to"))
    )
    joined = table.join(good, F.col(key) == F.col("_from"), "left")
    out = joined.withColumn("superseded_by", F.coalesce("_to", "superseded_by"))
    if status:
        out = out.withColumn(status, F.when(F.col("_to").isNotNull(), "superseded").otherwise(F.col(status)))
    return out.drop("_from", "_to")


def expire(pending: DataFrame, cutoff: Column) -> DataFrame:
    """Pending rows created strictly before the cutoff become expired; the cutoff itself stays pending."""
    old = (F.col("status") == "pending") & (F.col("created_at") < cutoff)
    return pending.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def keep_recent(table: DataFrame, at: str, cutoff: Column, days: int, open_column: str | None = None) -> DataFrame:
    """Rows at or after the cutoff, those without a time, and open ones; 0 days keep everything."""
    if days == 0:
        return table
    kept = F.col(at).isNull() | (F.col(at) >= cutoff)
    return table.where(kept | F.col(open_column).isNull() if open_column else kept)


def freed_by_keeping(table: DataFrame, group: str, newest: list[Column], keep: int, size: str) -> DataFrame:
    """(group, freed, freed_bytes): what goes where the newest `keep` rows of each group stay; groups that lose nothing have no row.

    Only the rows that stay are ranked, pruned to `keep` per group before the shuffle; the rest is what
    remains of the group's sums.
    """
    kept = table.select(group, size, F.row_number().over(Window.partitionBy(group).orderBy(*newest)).alias("_rn")).where(F.col("_rn") <= keep)
    sums = lambda df: df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    staying = sums(kept).select(F.col(group).alias("_group"), F.col("n").alias("_n"), F.coalesce("bytes", F.lit(0)).alias("_bytes"))
    joined = sums(table).join(staying, F.col(group).eqNullSafe(F.col("_group")))
    return joined.where("n > _n").select(group, (F.col("n") - F.col("_n")).alias("freed"), (F.col("bytes") - F.col("_bytes")).alias("freed_bytes"))


def orphans(child: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the child without a parent; keys are never null in the store."""
    return child.join(parents.select(*keys).distinct(), keys, "left_anti")


def sync_verdict(local: Column, remote: Column, baseline: Column) -> Column:
    """up-to-date, ahead, behind or diverged, from three digests; equal digests win whatever the baseline says."""
    return (
        F.when(local.eqNullSafe(remote), "up-to-date")
        .when(remote.isNull(), "no-remote")
        .when(remote.eqNullSafe(baseline), "ahead")
        .when(local.eqNullSafe(baseline), "behind")
        .otherwise("diverged")
    )
