"""The registry of stores on a machine, and runs that are claimed at most once an hour."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.operators.lifecycle import upsert

DEBOUNCE = "interval 1 hour"


def register(registry: DataFrame, opened: DataFrame, now: Column, explicit: bool = False) -> DataFrame:
    """The registry (root_path, last_seen, last_schema) after stores (root_path, last_schema) were opened.

    A known root is rewritten only if its schema changed or it was last seen more than an hour ago,
    unless it was registered explicitly.
    """
    known = registry.select(F.col("root_path").alias("_root"), "last_seen", F.col("last_schema").alias("_schema"))
    joined = opened.select("root_path", "last_schema").distinct().join(known, F.col("root_path") == F.col("_root"), "left")
    due = F.col("_root").isNull() | ~F.col("last_schema").eqNullSafe(F.col("_schema")) | F.coalesce(F.col("last_seen") < now - F.expr(DEBOUNCE), F.lit(True))
    rows = joined if explicit else joined.where(due)
    return upsert(registry, rows.select("root_path", now.alias("last_seen"), "last_schema"), ["root_path"])


def live_roots(registry: DataFrame, name: str = ".store") -> list[str]:
    """The roots that still hold a store; a look at each folder of this machine's registry."""
    return [r["root_path"] for r in registry.select("root_path").collect() if (Path(r["root_path"]) / name / "manifest.json").exists()]


def prune(registry: DataFrame, live: DataFrame) -> DataFrame:
    """The registry without the roots that hold no store any more."""
    return registry.join(live.select("root_path").distinct(), "root_path", "left_semi")


def may_run(last_run: Column, now: Column, interval: str = DEBOUNCE) -> Column:
    """Whether a debounced run may be claimed: never run, or strictly longer ago than the interval."""
    return last_run.isNull() | (last_run < now - F.expr(interval))
