"""Transcript lines as turn records, in the two shapes that agents write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_damaged(line: Column) -> Column:
    """Whether a line isn't blank and no JSON object; such lines are counted, never fatal."""
    text = F.trim(F.coalesce(line, F.lit("")))
    return (text != "") & (F.try_parse_json(text).isNull() | ~F.startswith(text, F.lit("{")))


def _count(*paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get("_v", p, "long") for p in paths], F.lit(0))


def message_usage(lines: DataFrame) -> DataFrame:
    """Lines of the first shape that carry usage (in message.usage or usage), with their counters; missing ones are 0.

    Text that holds a number counts as the number.
    """
    parsed = lines.withColumn("_v", F.try_parse_json("raw_line"))
    inner, outer = F.try_variant_get("_v", "$.message.usage", "variant"), F.try_variant_get("_v", "$.usage", "variant")
    counters = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}
    turns = parsed.where(inner.isNotNull() | outer.isNotNull())
    out = turns.withColumns({name: _count(f"$.message.usage.{field}", f"$.usage.{field}") for name, field in counters.items()})
    return out.withColumn("ts", F.try_to_timestamp(F.try_variant_get("_v", "$.timestamp", "string"))).drop("_v")


def event_usage(lines: DataFrame) -> DataFrame:
    """Token counts of the second shape; reasoning tokens count as output, nothing is written to a cache."""
    parsed = lines.withColumn("_v", F.try_parse_json("raw_line"))
    usage = "$.payload.info.last_token_usage"
    wanted = (F.try_variant_get("_v", "$.type", "string") == "event_msg") & (F.try_variant_get("_v", "$.payload.type", "string") == "token_count")
    turns = parsed.where(wanted & F.try_variant_get("_v", usage, "variant").isNotNull())
    return turns.select(
        *lines.columns,
        F.try_to_timestamp(F.try_variant_get("_v", "$.timestamp", "string")).alias("ts"),
        _count(f"{usage}.input_tokens").alias("input"),
        (_count(f"{usage}.output_tokens") + _count(f"{usage}.reasoning_output_tokens")).alias("output"),
        _count(f"{usage}.cached_input_tokens").alias("cache_read"),
        F.lit(0).cast("long").alias("cache_creation"),
    )
