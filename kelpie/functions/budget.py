"""Token budgets without a vocabulary: a documented approximation of four characters to a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approximate_tokens(text: Column) -> Column:
    """Characters divided by four, rounded up; 0 for an empty text, null for null."""
    return F.ceil(F.char_length(text) / F.lit(4.0)).cast("long")


def budget_class(tokens: Column, warn: int, fail: int) -> Column:
    """ok, warn or fail against two thresholds; a threshold itself is still the better class."""
    return F.when(tokens > fail, "fail").when(tokens > warn, "warn").otherwise("ok")
