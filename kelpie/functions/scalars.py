"""Scalar functions: text, time, scores, vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def clip(text: Column, most: int) -> Column:
    """The text, cut to `most` characters with an ellipsis in the last place if it is longer."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def snippet(text: Column, lines: int = 6, most: int = 400) -> Column:
    """The first lines of a text, at most so many characters; an ellipsis marks what was cut."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    short = F.left(head, F.lit(most))
    return F.when(F.char_length(short) < F.char_length(text), F.concat(short, F.lit("…"))).otherwise(text)


def age_decay(age_days: Column, half_life_days: float) -> Column:
    """exp(-age ln 2 / half life); exactly 1 when switched off (not above 0), for no age and for none yet."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.when(age_days.isNull() | (age_days <= 0), F.lit(1.0)).otherwise(F.exp(-age_days * F.lit(math.log(2) / half_life_days)))


def clamp01(value: Column) -> Column:
    """The value within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for vectors of different lengths, without length or null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (norms > 1e-12)
    return F.when(F.coalesce(fits, F.lit(False)), dot(a, b) / norms).otherwise(F.lit(0.0))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Normalised so that the smallest (best) value is 1 and the greatest 0; all 1 if they are equal; 0 for null."""
    return F.when(value.isNull(), 0.0).when(high == low, 1.0).otherwise((high - value) / (high - low))


def cell(text: Column) -> Column:
    """A text as a Markdown table cell: bars escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s+", " "))


def slug(url: Column) -> Column:
    """A remote's address without scheme, user, port and suffix, as host/path; then lower case with dashes."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-z+]+://|^[^@/]+@", ""), r"\.git/?$|/$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r":", "/")), r"[^a-z0-9]+", "-")


def embed_text(kind: Column, title: Column, body: Column) -> Column:
    """The text that is embedded: title and body on lines of their own; for notes the body alone."""
    return F.when(kind == "note", body).when(body.isNull() | (body == ""), title).otherwise(F.concat(title, F.lit("\n"), body))
