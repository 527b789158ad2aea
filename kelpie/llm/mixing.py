"""Mixing sources to target weights (problem 7).

Method: Pareto order sampling. Each source's wanted tokens are divided by the tokens it has; the whole
part are copies that every document gets for certain. For the rest each document gets an inclusion
probability, and documents are ranked by their random odds divided by their inclusion odds; the ranks
are taken in order until the wanted tokens are reached, so every sample has a fixed size.

The inclusion probability falls with the root of a document's length, scaled so that the expected
tokens are the wanted ones: short documents fill the rest finely, long ones would overshoot it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096  # steps of the rank key in which sums are gathered before any two documents are compared


def source_totals(documents: DataFrame) -> DataFrame:
    """Per source: tokens, root tokens and documents; `all_tokens` is the sum over all sources."""
    totals = documents.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.sqrt(F.col("n_tokens").cast("double"))).alias("roots"),
        F.count(F.lit(1)).alias("documents"),
    )
    everything = Window.partitionBy(F.lit(0))  # one row per source
    return totals.withColumn("all_tokens", F.sum("tokens").over(everything))


def allotments(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: the tokens wanted, the certain copies and the tokens left to sample.

    A row that repeats in `targets` counts once; a null share counts as 0, null repeats as none. A
    source without documents has no tokens, so any wish for it cannot be met.
    """
    whole = targets.select("mix_id", "source", "target_share", "max_repeats", "size_share").distinct()
    joined = whole.join(totals, "source", "left").withColumn(
        # for a source that has no documents the sum over all comes from the others
        "all_tokens", F.coalesce("all_tokens", F.max("all_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0))
    )
    has = F.coalesce("tokens", F.lit(0))
    most = has * F.coalesce("max_repeats", F.lit(0))
    wanted = F.coalesce(F.col("target_share") * F.col("size_share") * F.col("all_tokens"), F.lit(0.0))
    reached = F.least(wanted, most.cast("double"))
    return joined.select(
        "mix_id",
        "source",
        "target_share",
        "size_share",
        "max_repeats",
        "all_tokens",
        has.alias("tokens"),
        "roots",
        wanted.alias("wanted"),
        (wanted > most).alias("short"),
        F.when(has > 0, F.floor(reached / has)).otherwise(0).cast("long").alias("certain"),
    ).withColumn("rest", F.greatest(reached - F.col("certain") * F.col("tokens"), F.lit(0.0)))


def _key(seed: int):
    """The rank key: Pareto's ratio r mapped to r / (1 + r), which keeps the order and lies in [0, 1)."""
    uniform = (F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    length = F.greatest(F.col("n_tokens").cast("double"), F.lit(1.0))
    chance = F.least(F.greatest(F.col("rest") / (F.col("roots") * F.sqrt(length)), F.lit(1e-9)), F.lit(1 - 1e-9))
    ratio = (uniform / (1 - uniform)) / (chance / (1 - chance))
    return ratio / (1 + ratio)


def mixtures(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies) of every document with at least one copy in a mix.

    `documents` has doc_id, source and n_tokens. Copies never exceed max_repeats; the sampled part ends
    with the document whose tokens bring the sum nearest to the wanted ones, so a source misses its
    target by half a document at most. Documents of 0 tokens get the certain copies only. A null source
    is no source of any mix.

    No source is sorted in one place: tokens are summed in BINS steps of the rank key, steps wholly
    under the target are taken, and only the documents of the step that crosses it are ranked.
    """
    allotted = allotments(source_totals(documents), targets)
    ranked = documents.where(F.col("source").isNotNull()).join(allotted.drop("tokens", "all_tokens"), "source").withColumn("_key", _key(seed))
    ranked = ranked.withColumn("_bin", F.least(F.floor(F.col("_key") * BINS), F.lit(BINS - 1)).cast("int"))
    sampled = ranked.where((F.col("rest") > 0) & (F.col("n_tokens") > 0))
    steps = sampled.groupBy("mix_id", "source", "_bin").agg(F.sum("n_tokens").alias("_sum"))
    upto = Window.partitionBy("mix_id", "source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("mix_id", "source", "_bin", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"), "_sum")
    placed = ranked.join(steps, ["mix_id", "source", "_bin"], "left")
    inside = (F.col("rest") > 0) & (F.col("n_tokens") > 0)
    whole = inside & (F.col("_before") + F.col("_sum") <= F.col("rest"))
    crossing = inside & ~whole & (F.col("_before") < F.col("rest"))
    out = ["mix_id", "source", "doc_id", "n_tokens", "certain", "max_repeats"]
    plain = placed.where(~F.coalesce(crossing, F.lit(False))).select(*out, F.coalesce(whole, F.lit(False)).cast("long").alias("extra"))
    order = Window.partitionBy("mix_id", "source", "_bin").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    near = (F.col("rest") - start) * 2 >= F.col("n_tokens")  # taking it ends nearer than leaving it
    edge = placed.where(F.coalesce(crossing, F.lit(False))).select(*out, ((start < F.col("rest")) & near).cast("long").alias("extra"))
    copies = F.least(F.col("certain") + F.col("extra"), F.coalesce("max_repeats", F.lit(0)))
    return plain.unionByName(edge).withColumn("copies", copies).where("copies > 0").select("mix_id", "source", "doc_id", "n_tokens", "copies")


def mixture_shares(documents: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per row of `targets`: tokens wanted and reached, the share asked for and the share reached.

    The share reached is of the mixture's own tokens, null for an empty mixture.
    """
    allotted = allotments(source_totals(documents), targets)
    used = mixed.groupBy("mix_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
    )
    joined = allotted.join(used, ["mix_id", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    return joined.select(
        "mix_id",
        "source",
        "target_share",
        F.round("wanted", 3).alias("wanted_tokens"),
        "mixed_tokens",
        F.expr("try_divide(mixed_tokens, sum(mixed_tokens) over (partition by mix_id))").alias("actual_share"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "max_repeats",
        "short",
    )


def unmet_by_mixture(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_id, source) of the targets that their mixture misses, all documents at the cap; the totals confirm it."""
    shares = mixture_shares(documents, targets, mixtures(documents, targets, seed))
    missed = (F.col("mixed_tokens") <= F.col("wanted_tokens")) & (F.coalesce("most_copies", F.lit(0)) <= F.coalesce("max_repeats", F.lit(0)))
    return shares.where(missed & F.col("short")).select("mix_id", "source").distinct()


def unmet(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source) of the targets that all repeats of all documents of the source can't reach."""
    return allotments(source_totals(documents), targets).where("short").select("mix_id", "source").distinct()
