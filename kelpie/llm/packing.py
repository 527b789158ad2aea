"""Filling fixed-capacity containers with items (problem 6).

Method: minimum bin slack. Items of one length are interchangeable, so the problem is the multiset of
lengths, at most `capacity` different ones whatever the number of items. Each container's filling is
the sub-multiset that comes closest to the capacity, found by a bitset subset-sum over the remaining
lengths and traced back to counts; it is repeated for as many containers as the counts allow.

Only the counts per length reach the driver. Items are numbered within their length in parallel, and
a number falls into one range of the plan, which names the container.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.session import cut


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of `counts` whose lengths sum up closest to `room` from below.

    Lengths are tried longest first; bit s of `reach` says that sum s can be made. Bounded counts are
    split into powers of two, so each length costs log2(room / length) shifts of a `room`-bit number.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


@dataclass
class Plan:
    """Ranges of item numbers per length: number n of a range lies in container first + (n - start) // each."""

    containers: int = 0
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, start, first container, each


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """Containers for all items; every length is between 1 and the capacity.

    Each filling starts from the longest item left, so none is put off to the end. A filling is used
    again while its counts last, so the number of fillings follows the number of lengths.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    plan = Plan()
    while left:
        longest = max(left)
        left_after = {k: n - (k == longest) for k, n in left.items()}
        chosen = fill({k: n for k, n in left_after.items() if n > 0 and k <= capacity - longest}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // each for k, each in chosen.items())
        for length, each in chosen.items():
            plan.ranges.append((length, used[length], plan.containers, each))
            used[length] += times * each
            left[length] -= times * each
            if not left[length]:
                del left[length]
        plan.containers += times
    return plan


def sum_before(df: DataFrame, group: str, order: str, amount: Column, slices: int = 256) -> DataFrame:
    """`_before`: the sum of `amount` over the rows before each row in its `group`, in a fixed order.

    The group is spread over slices by hash of `order`. Sums run within (group, slice), and each slice
    starts where those before it end; only the totals of the slices meet in one place. With an amount
    of 1 it numbers the rows from 0.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(order), F.lit(slices))).withColumn("_amount", amount.cast("long"))
    sizes = sliced.groupBy(group, "_slice").agg(F.sum("_amount").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = sliced.withColumn("_i", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return summed.join(starts, [group, "_slice"]).withColumn("_before", F.col("_start") + F.col("_i")).drop("_slice", "_start", "_i", "_amount")


def pack(items: DataFrame, capacity: int, item: str = "doc_id", length: str = "n_tokens") -> DataFrame:
    """(item, piece_no, n_pieces, start_at, piece_size, container_id) for every item.

    An item longer than the capacity is split: its whole-capacity pieces fill a container each, the
    rest is packed like an item. Others are never split. An item of length 0 or null takes no space: it
    has one piece of size 0 and no container. Items with the same id are told apart only by their
    lengths; give unique ids.
    """
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    whole = F.floor(size / F.lit(capacity)).cast("long")
    rest = (size % F.lit(capacity)).cast("long")
    sized = cut(items.select(F.col(item).alias("_item"), whole.alias("_whole"), rest.alias("_rest")))
    counts = {int(r["_rest"]): int(r["n"]) for r in sized.where("_rest > 0").groupBy("_rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_containers(counts, capacity)  # at most capacity - 1 counts, whatever the items
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    for key, *row in plan.ranges:
        ranges.setdefault(key, []).append(tuple(row))
    by_length = {key: tuple(np.array(column, dtype=np.int64) for column in zip(*rows)) for key, rows in ranges.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, numbers = batch["_rest"].to_numpy(), batch["_before"].to_numpy()
            container = np.zeros(len(batch), dtype=np.int64)
            for key in np.unique(lengths):
                starts, firsts, each = by_length[int(key)]
                mine = lengths == key
                at = np.searchsorted(starts, numbers[mine], side="right") - 1
                container[mine] = firsts[at] + (numbers[mine] - starts[at]) // each[at]
            yield pd.DataFrame({
                "item": batch["_item"], "piece_no": batch["_whole"], "n_pieces": batch["_whole"] + 1,
                "start_at": batch["_whole"] * capacity, "piece_size": lengths, "container_id": container,
            })

    schema = "item long, piece_no long, n_pieces long, start_at long, piece_size long, container_id long"
    rests = sum_before(sized.where("_rest > 0"), "_rest", "_item", F.lit(1)).select("_item", "_whole", "_rest", "_before").mapInPandas(place, schema)
    longer = sum_before(sized.where("_whole > 0").withColumn("_all", F.lit(0)), "_all", "_item", F.col("_whole"))
    wholes = longer.select(
        F.col("_item").alias("item"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)).alias("piece_no"),
        (F.col("_whole") + F.when(F.col("_rest") > 0, 1).otherwise(0)).alias("n_pieces"),
        "_before",
    ).select(
        "item",
        "piece_no",
        "n_pieces",
        (F.col("piece_no") * capacity).alias("start_at"),
        F.lit(capacity).cast("long").alias("piece_size"),
        (F.lit(plan.containers) + F.col("_before") + F.col("piece_no")).alias("container_id"),
    )
    empty = sized.where("_whole = 0 and _rest = 0").select(
        F.col("_item").alias("item"), F.lit(0).cast("long").alias("piece_no"), F.lit(1).cast("long").alias("n_pieces"),
        F.lit(0).cast("long").alias("start_at"), F.lit(0).cast("long").alias("piece_size"), F.lit(None).cast("long").alias("container_id"),
    )
    return rests.unionByName(wholes).unionByName(empty).withColumnRenamed("item", item)


def oversized(packed: DataFrame, item: str = "doc_id") -> DataFrame:
    """The items that lie in several containers, as only items larger than a container do."""
    return packed.groupBy(item).agg(F.count_distinct("container_id").alias("_containers")).where("_containers > 1").select(item)
