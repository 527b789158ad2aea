"""JSON with comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without_comment(line: Column) -> Column:
    parts = F.split(line, '"')  # every second part is in quotes
    outside = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2))
    first = F.filter(outside, lambda i: F.contains(F.get(parts, i), F.lit("//")))
    kept = F.transform(first, lambda i: F.array_join(F.concat(F.slice(parts, 1, i), F.array(F.substring_index(F.get(parts, i), "//", 1))), '"'))
    return F.when(F.contains(line, F.lit("//")), F.coalesce(F.get(kept, F.lit(0)), line)).otherwise(line)


def strip_line_comments(text: Column) -> Column:
    """The text without what follows // outside double quotes on each line.

    A quote that is open runs to the line's end; escaped quotes and block comments aren't known. Lines
    may be of any length: nothing here recurses.
    """
    return F.array_join(F.transform(F.split(text, "\n"), _without_comment), "\n")
