"""Digests of tables: equal for equal rows whatever their order in the files, different for null and empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from kelpie.operators.series import sliced


def row_frame(columns: list[str]) -> Column:
    """A row as text: each value with its length, nulls by a mark of their own."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), "N;").otherwise(F.concat(F.lit("V"), F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.concat(*parts)


def table_digest(df: DataFrame, name: str, keys: list[str], columns: list[str], slices: int = 4096) -> DataFrame:
    """(table_name, row_count, digest): SHA-256 over the table's name and its rows in the order of their keys.

    The rows' digests are put in the order of the keys within slices of the first key, and the slices'
    digests in the order of the slices, so no list is longer than a slice and nothing is sorted in one
    place. A key that is a number or an instant is sliced by ranges, another one by its hash. Rows with
    the same key are put in the order of their digests.
    """
    ranged = isinstance(df.schema[keys[0]].dataType, (NumericType, TimestampType, DateType))
    placed = sliced(df, F.col(keys[0]), slices) if ranged else df.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int"))
    hashed = placed.select("_slice", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.sha2(F.encode(row_frame(columns), "UTF-8"), 256).alias("h"))
    rows = F.array_sort(F.collect_list(F.struct(*[f"_k{i}" for i in range(len(keys))], "h")))
    by_slice = hashed.groupBy("_slice").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("_slice", "d")))
    whole = by_slice.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.sha2(F.concat(F.lit(f"{name}|"), F.array_join(F.transform(ordered, lambda s: F.concat(s["_slice"].cast("string"), F.lit("="), s["d"])), "|")), 256).alias("digest"),
    )
    return whole.select(F.lit(name).alias("table_name"), "row_count", "digest")
