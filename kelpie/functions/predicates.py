"""Predicates and classes over columns: staleness, windows, provenance, paths, deny lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Top folders whose files count as tests, the default deny list, and file endings by language.
TEST_FOLDERS = ["tests/", "benches/", "examples/"]
DEFAULT_DENY = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_rsa.*", "id_dsa", "id_dsa.*", "id_ecdsa", "id_ecdsa.*",
    "id_ed25519", "id_ed25519.*", "secrets/**", ".aws/credentials", ".gcloud/credentials*", ".gnupg/**",
]
LANGUAGE_OF_EXTENSION = {
    "rs": "rust", "cs": "csharp", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go",
}


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, as a difference of Julian days would give them."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)


def is_stale(verified_at: Column, as_of: Column, horizon_days: int) -> Column:
    """Never verified, or verified strictly more than the horizon ago; exactly the horizon is fresh."""
    return verified_at.isNull() | (days_between(as_of, verified_at) > horizon_days)


def within_days(at: Column, as_of: Column, days: int) -> Column:
    """At or after as_of minus the days; a null instant is outside."""
    return F.coalesce(at >= as_of - F.make_interval(days=F.lit(days)), F.lit(False))


def is_accepted(source: Column) -> Column:
    """Written by the user, or by an agent on the user's behalf."""
    return F.coalesce((source == "user") | source.startswith("user+agent:"), F.lit(False))


def blank_label(column: Column) -> Column:
    """The value, or '(blank)' where it is null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("(blank)"))


def has_all(text: Column, needles: list[str]) -> Column:
    """Whether a text holds all needles whatever their case; true for none, false for a null text."""
    tests = [F.contains(F.lower(text), F.lit(n.lower())) for n in needles]
    return F.coalesce(reduce(lambda a, b: a & b, tests, text.isNotNull()), F.lit(False))


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """The class that opens at `at`, and the place after it; a closing bracket that comes first is a member."""
    start = at + 2 if pattern[at + 1 : at + 2] in ("!", "^") else at + 1
    close = pattern.find("]", start + 1)
    if close < 0:
        raise ValueError(f"open bracket in {pattern!r}")
    members = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[start:close])
    return f"[{'^' if start > at + 1 else ''}{members}]", close + 1


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: *, ?, **, classes and alternatives in braces, which may be nested.

    ValueError for an open bracket or brace, so that a bad list never denies less than it says.
    """
    out, depth, at = "", 0, 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif pattern[at] == "[":
            part, at = _bracket(pattern, at)
            out += part
        elif pattern[at] == "\\" and at + 1 < len(pattern):
            out, at = out + re.escape(pattern[at + 1]), at + 2
        else:
            c = pattern[at]
            depth += (c == "{") - (c == "}")
            if depth < 0:
                raise ValueError(f"closing brace in {pattern!r}")
            special = {"*": ".*", "?": ".", "{": "(?:", "}": ")"} | ({",": "|"} if depth else {})
            out, at = out + special.get(c, re.escape(c)), at + 1
    if depth:
        raise ValueError(f"open brace in {pattern!r}")
    return out


def deny_regex(globs: list[str]) -> str:
    """One expression that matches a path if a glob matches the path or what follows any of its slashes."""
    if not globs:
        return r"(?!)"
    return "(?s)(^|/)(?:" + "|".join(f"(?:{glob_regex(g)})" for g in globs) + r")\z"


def is_denied(path: Column, globs: list[str]) -> Column:
    """Whether a deny list covers a path; leading './' don't count, however many. Null paths aren't denied."""
    return F.coalesce(F.regexp_replace(path, r"^(?:\./)+", "").rlike(deny_regex(globs)), F.lit(False))


def is_test_path(path: Column) -> Column:
    """Whether a repository's path lies in a top folder of tests; folders of that name further down are none."""
    return reduce(lambda a, b: a | b, (F.startswith(path, F.lit(f)) for f in TEST_FOLDERS))


def path_class(path: Column) -> Column:
    """test, minified (by the file's own name), path or text: what a string looks like as a path."""
    name = F.element_at(F.split(path, "/"), -1)
    looks = path.contains("/") | path.contains("\\") | path.contains(".")
    return F.when(is_test_path(path), "test").when(name.contains(".min."), "minified").when(looks, "path").otherwise("text")


def language_of(path: Column) -> Column:
    """Language by extension, null for others."""
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair])
    return F.try_element_at(names, F.lower(extension))
