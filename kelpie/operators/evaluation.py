"""Evaluation of rankings against golden queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(ranked: DataFrame, golden: DataFrame, text: str, cuts: tuple[int, ...]) -> DataFrame:
    """(query_id, at_<k>): 1 if a result within rank k holds all needles of the query, whatever their case.

    `ranked` has query_id, rank and the text; queries without results have no row.
    """
    good = F.forall("needles", lambda n: F.contains(F.lower(text), F.lower(n)))
    joined = ranked.join(golden, "query_id").withColumn("_good", F.coalesce(good, F.lit(False)))
    return joined.groupBy("query_id").agg(*[F.max((F.col("_good") & (F.col("rank") <= k)).cast("int")).alias(f"at_{k}") for k in cuts])


def evaluate(ranked: DataFrame, golden: DataFrame, text: str, cuts: tuple[int, ...], latencies: DataFrame | None = None) -> DataFrame:
    """One row: how many golden queries should match and do within each cut, how many should be empty and
    aren't (safety failures), and the median of `latencies` (ms) if given.

    `golden` has query_id, kind (match or empty) and needles; `ranked` has query_id, rank and the text.
    """
    hits = recall_at(ranked, golden, text, cuts)
    answered = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    each = golden.join(hits, "query_id", "left").join(answered, "query_id", "left")
    match, empty = F.col("kind") == "match", F.col("kind") == "empty"
    out = each.agg(
        F.count_if(match).alias("matches"),
        *[F.count_if(match & (F.coalesce(f"at_{k}", F.lit(0)) == 1)).alias(f"at_{k}") for k in cuts],
        F.count_if(empty).alias("empties"),
        F.count_if(empty & (F.coalesce("_hits", F.lit(0)) > 0)).alias("safety_failures"),
    )
    if latencies is None:
        return out
    timed = latencies.agg(F.median("ms").alias("median_ms")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(timed, "_one").drop("_one")
