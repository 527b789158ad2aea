"""Order-dependent operators that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_in_group(df: DataFrame, group: str, order: str, bucket: Column, take: str, out: str) -> DataFrame:
    """For each row the `take` value of the row before it in its group, null for the first.

    `bucket` must be monotone in `order` (hours of a timestamp, say). Within a bucket it is a plain
    lag; a bucket's first row gets the last row of the nearest earlier bucket. So a group with a third
    of all rows is spread over its buckets, and only one row per bucket meets in the second window.
    Rows with a null order come first, ties are ordered by `take`.
    """
    df = df.withColumn("_b", bucket)
    inner = Window.partitionBy(group, "_b").orderBy(F.col(order).asc_nulls_first(), take)
    lagged = df.withColumn("_p", F.lag(take).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    tails = df.groupBy(group, "_b").agg(F.max(F.struct(order, take)).getField(take).alias("_tail"))
    across = Window.partitionBy(group).orderBy(F.col("_b").asc_nulls_first())
    heads = tails.select(
        F.col(group).alias("_g"), F.col("_b").alias("_hb"), F.lag("_tail").over(across).alias("_head")
    )
    joined = lagged.join(
        heads, F.col("_first") & F.col(group).eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_hb")), "left"
    )
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_p"))).drop(
        "_b", "_p", "_first", "_g", "_hb", "_head"
    )
