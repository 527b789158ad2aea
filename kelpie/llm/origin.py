"""Generated, minified, vendored and data files among source files (problem 1).

Method: threshold layout statistics, tuned per language: maximum and mean line length, white-space
share, alphanumeric share, numeric-literal density, long encoded runs, the share of long lines without
white space, of rows of literals and of lines that differ from others by their numbers only. They name
data, minified and generated files by layout; the marks that tools and packages leave in a file's head
and path, and the list of known third-party files, are the second evidence.

Statistics are sums and maxima over chunks, computed in the scan by built-in functions and combined
before the shuffle, so a file that holds a third of all chunks costs no more than another.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LONG_LINE = 200  # characters; people break lines before


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language."""

    max_line: float = 300.0  # minified: a line longer than this, and ...
    mean_line: float = 150.0  # ... a mean line above this or ...
    dense_share: float = 0.6  # ... so many of the characters in long lines with hardly a space
    space_share: float = 0.08  # minified: white space below this share of the (long lines') characters
    alnum_share: float = 0.75  # minified: below this share of the (long lines') characters; above it they are words or data
    encoded_share: float = 0.6  # data: characters in long encoded runs, of a file that is ...
    encoded_alnum: float = 0.8  # ... letters and digits to this share, or has all but no white space
    table_share: float = 0.7  # data: lines that are rows of literals, and ...
    number_share: float = 0.3  # ... literals among literals and words
    repeat_share: float = 0.6  # generated: lines that equal another but for their numbers


# Scripts are minified far more often than the others, and harder, so less evidence is asked of them.
# Indentation carries meaning in Python and is deep in C# and Java, so white space stays there even in
# bundles. Go and Rust are formatted by tools: their lines are short, their error handling and match
# arms repeat, so long lines say more there and repeats less.
LIMITS = {
    "javascript": Limits(mean_line=120.0, space_share=0.10, dense_share=0.5),
    "typescript": Limits(mean_line=120.0, space_share=0.10, dense_share=0.5),
    "python": Limits(mean_line=160.0, space_share=0.06),
    "java": Limits(max_line=320.0, mean_line=160.0, space_share=0.09),
    "csharp": Limits(max_line=320.0, mean_line=160.0, space_share=0.09),
    "go": Limits(max_line=260.0, mean_line=130.0, repeat_share=0.65),
    "rust": Limits(max_line=260.0, mean_line=130.0, repeat_share=0.65),
}

# File extensions, and the other spellings of languages, by language.
LANGUAGES = {
    "rust": ["rs", "rust"],
    "python": ["py", "pyi", "python"],
    "typescript": ["ts", "tsx", "mts", "cts", "typescript"],
    "javascript": ["js", "jsx", "mjs", "cjs", "javascript"],
    "go": ["go", "golang"],
    "java": ["java"],
    "csharp": ["cs", "csharp", "c#"],
}

# What tools write into the first lines of their output.
TOOL_MARKS = [
    r"@generated\b",
    r"<auto-?generated",
    r"\bcode generated by\b",
    r"\bauto-?generated (?:file|from|by|with|using)\b",
    r"\bthis (?:file|code|source) (?:is|was) (?:auto-?|automatically |machine-?)?(?:produced|generated|created) (?:by|from)\b",
    r"\bmachine-(?:written|generated)\b",
    r"\bdo not (?:edit|modify)\W+(?:output of|generated)",
    r"\b(?:output of|produced by) \S+.*\b(?:changes|edits) (?:will be|get) (?:lost|overwritten)\b",
    r"\b(?:généré|genere) (?:par|avec|automatiquement)\b",
    r"\bautomatisch (?:erzeugt|generiert|erstellt)\b",
    r"\b(?:generado|creado) (?:por|automáticamente|con)\b",
]

# Notes by which people say that a file is theirs.
OWN_MARKS = [
    r"\bnot generated\b",
    r"\bmaintained by hand\b",
    r"\bedit (?:freely|here)\b",
    r"\b(?:our own|written for this)\b",
    r"\b(?:forked|taken over|adopted)\b",
]

# How the head of a third party's file names its package, which must be a known one.
PACKAGE_NOTE = (
    r"(?im)(?:^\W*|@license\s+|\bcopied (?:unchanged|verbatim) from\s+|\bvendored from\s+|\bupstream:\s*)"
    r"([a-z][\w\-]*)(?:\s+v?\d+(?:\.\d+)+\s*(?:$|[|,]|\S+-\d[\d.]*\s*$)|\s*-\s*version\s+\d|@[0-9a-f]{6,}|\s+release\s+v?\d)"
)

# Folders and file names that only tools write to.
TOOL_PATHS = [
    r"/__generated__/",
    r"/src/generated/",
    r"/generated-(?:sources|src)/",
    r"/gen/(?:proto|go|java|python|ts)/",
    r"/build/(?:autogen|generated)/",
    r"/obj/(?:debug|release)/",
    r"\.pb\.(?:go|cc|h|ts|js|rs|java|cs)$",
    r"_pb2(?:_grpc)?\.pyi?$",
    r"\.(?:g|g\.i|designer)\.cs$",
    r"[._](?:generated|gen|autogen)\.[a-z]+$",
    r"/zz_generated[._]",
    r"_bindgen\.rs$",
    r"/autovalue_\w+\.java$",
    r"outerclass\.java$",
    r"grpc\.(?:java|cs)$",
]

# Names of minified or bundled files, and folders that hold third parties' packages.
BUNDLE_PATHS = [r"[.\-]min\.[a-z]+$", r"\.(?:umd|bundle)(?:\.min)?\.[a-z]+$", r"[.\-][0-9a-f]{8}\.(?:[mc]?js|ts)$"]
PACKAGE_FOLDERS = (
    "vendor|vendors|vendored|third_party|third-party|thirdparty|external|deps|pods|site-packages|dist-packages|"
    "bower_components|jspm_packages|node_modules|carthage|godeps"
)
VERSIONED_FOLDERS = "lib|libs|packages"  # these hold own code too, so only a folder with a version counts

_NUMBER = r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)(?![\w.])"
_WORD = r"[A-Za-z_]\w*"
_ENCODED = r"[A-Za-z0-9+/=_\-]{64,}"
_ROW = r"(?m)^[ \t]*(?:[\[{(]*-?(?:0[xX][0-9a-fA-F]+|\d)[ \t\d.,xXa-fA-F\-\]})]*|\{[ \t]*\"\w+\":.*\}),?[ \t]*$"
_REMARK = r"^\s*(?://|#|/\*|\*|--|<!--|;)"


def language_of(path: Column, language: Column) -> Column:
    """The language by the extension, else by the (differently spelt) language column, else null."""
    extension = F.regexp_extract(F.lower(path), r"\.([a-z]+)$", 1)
    named = F.lower(F.trim(language))
    out = F.lit(None).cast("string")
    for source in (named, extension):
        chain = F.lit(None).cast("string")
        for name, spellings in LANGUAGES.items():
            chain = F.when(source.isin(spellings), name).otherwise(chain)
        out = F.coalesce(chain, out)
    return out


def clean_path(path: Column) -> Column:
    """Lower case, forward slashes, one leading slash, no leading './'."""
    return F.concat(F.lit("/"), F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^(?:\./|/)+", ""))


def chunk_body(embed_text: Column) -> Column:
    """What follows the path and the blank line; the whole text if there is no blank line."""
    at = F.locate("\n\n", embed_text)
    return F.coalesce(F.when(at > 0, F.substring(embed_text, at + 2, F.length(embed_text))).otherwise(embed_text), F.lit(""))


def _any(patterns: list[str]) -> str:
    return "(?im)" + "|".join(f"(?:{p})" for p in patterns)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Per chunk: counts that add up over a file, and the comment lines at its start."""
    body = F.col("body")
    long_lines = F.filter("_lines", lambda line: F.length(line) > LONG_LINE)
    bare = lambda line: F.length(F.translate(line, " \t", ""))
    dense = F.filter(long_lines, lambda line: F.length(line) - bare(line) < 0.1 * F.length(line))
    total = lambda lines: F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))
    numbered = F.transform(F.filter("_lines", lambda line: line.rlike("[0-9]")), lambda line: F.regexp_replace(F.trim(line), r"0[xX][0-9a-fA-F]+|\d+", "#"))
    # the comment lines at the start, blank ones between them too, line by line: files may have any number of them
    code = F.filter(F.transform("_lines", lambda line, i: F.when((F.trim(line) == "") | line.rlike(_REMARK), -1).otherwise(i)), lambda i: i >= 0)
    head = F.slice("_lines", 1, F.coalesce(F.get(code, F.lit(0)), F.size("_lines")))
    removed = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    return chunks.select("id", "file_id", chunk_body(F.col("embed_text")).alias("body")).withColumn("_lines", F.split("body", "\n")).select(
        "id",
        "file_id",
        F.length(body).cast("long").alias("chars"),
        F.size("_lines").cast("long").alias("lines"),
        F.array_max(F.transform("_lines", F.length)).alias("max_line"),
        total(dense).cast("long").alias("dense"),
        total(F.transform(dense, lambda line: F.regexp_replace(line, "[^A-Za-z0-9]+", ""))).cast("long").alias("dense_alnum"),
        (F.size(numbered) - F.size(F.array_distinct(numbered))).cast("long").alias("repeats"),
        removed(r"\s+").alias("spaces"),
        removed(r"[A-Za-z0-9]+").alias("alnum"),
        F.regexp_count(body, F.lit(_NUMBER)).alias("numbers"),
        F.regexp_count(F.regexp_replace(body, r'"[^"\n]*"', '""'), F.lit(_WORD)).alias("words"),
        removed(_ENCODED).alias("encoded"),
        F.regexp_count(body, F.lit(_ROW)).alias("rows"),
        F.regexp_count(body, F.lit(r"(?m)^[ \t]*(?://|#|/\*|\*|$)")).alias("remarks"),
        F.array_join(head, "\n").alias("head"),
    )


def file_statistics(chunks: DataFrame) -> DataFrame:
    """Per file: layout statistics over all its chunks, and the head of its first chunk."""
    sums = ["chars", "lines", "spaces", "alnum", "numbers", "words", "encoded", "rows", "dense", "dense_alnum", "repeats", "remarks"]
    return (
        chunk_statistics(chunks)
        .groupBy("file_id")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.max("max_line").alias("max_line"),
            F.min(F.struct("id", "head"))["head"].alias("head"),
        )
        .select(
            "file_id",
            "chars",
            "lines",
            "max_line",
            "head",
            (F.col("chars") / F.greatest("lines", F.lit(1))).alias("mean_line"),
            (F.col("spaces") / F.greatest("chars", F.lit(1))).alias("space_share"),
            (F.col("alnum") / F.greatest("chars", F.lit(1))).alias("alnum_share"),
            (F.col("numbers") / F.greatest(F.col("numbers") + F.col("words"), F.lit(1))).alias("number_share"),
            (F.col("encoded") / F.greatest(F.col("chars") - F.col("spaces"), F.lit(1))).alias("encoded_share"),
            (F.col("rows") / F.greatest(F.col("lines") - F.col("remarks"), F.lit(1))).alias("table_share"),
            (F.col("dense") / F.greatest("chars", F.lit(1))).alias("dense_share"),
            (F.col("dense_alnum") / F.greatest("dense", F.lit(1))).alias("dense_alnum_share"),
            (F.col("repeats") / F.greatest(F.col("lines") - F.col("remarks"), F.lit(1))).alias("repeat_share"),
        )
    )


def _limit(name: str) -> Column:
    chain = F.lit(getattr(Limits(), name))
    for language, limits in LIMITS.items():
        chain = F.when(F.col("true_language") == language, getattr(limits, name)).otherwise(chain)
    return chain


def file_origins(files: DataFrame, chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """Each file with its statistics and its origin: generated, minified, vendored, data or hand.

    `upstream` is the fixed list of known third-party files; its package names and content hashes are
    joined, never collected. A file without chunks is judged by path and hash alone. A null path counts
    as empty, a null language as unknown; files that repeat give one row each.
    """
    stats = file_statistics(chunks)
    known = upstream.where(F.col("content_hash").isNotNull()).select("content_hash").distinct().withColumn("_known", F.lit(True))
    packages = upstream.where(F.col("package_name").isNotNull()).select(F.lower("package_name").alias("_package")).distinct()
    base = (
        files.select("id", "path", "language", "content_hash")
        .withColumn("_path", F.coalesce(clean_path(F.col("path")), F.lit("/")))
        .withColumn("true_language", language_of(F.col("path"), F.col("language")))
        .withColumn("_folder", F.regexp_extract("_path", rf"/(?:{PACKAGE_FOLDERS})/([^/]+)/", 1))
        .withColumn("_folder", F.regexp_replace("_folder", r"[.\-@_]v?\d+(?:\.\d+)+$", ""))
        .withColumn("_versioned", F.regexp_extract("_path", rf"/(?:{VERSIONED_FOLDERS})/([a-z][\w\-]*?)[.\-@_]v?\d+(?:\.\d+)+/", 1))
        .withColumn("_folder", F.when(F.col("_folder") == "", F.col("_versioned")).otherwise(F.col("_folder")))
    )
    joined = (
        base.join(stats, base["id"] == stats["file_id"], "left")
        .join(known, "content_hash", "left")
        .join(packages, F.col("_folder") == F.col("_package"), "left")
        .withColumn("_note", F.lower(F.regexp_extract(F.coalesce("head", F.lit("")), PACKAGE_NOTE, 1)))
        .join(packages.withColumnRenamed("_package", "_noted"), F.col("_note") == F.col("_noted"), "left")
    )
    head = F.coalesce(F.col("head"), F.lit(""))
    own = head.rlike(_any(OWN_MARKS))
    limit = {f.name: _limit(f.name) for f in dataclasses.fields(Limits)}
    spaceless = F.col("space_share") < limit["space_share"]
    minified = (F.col("max_line") > limit["max_line"]) & (
        ((F.col("mean_line") > limit["mean_line"]) & spaceless & (F.col("alnum_share") < limit["alnum_share"]))
        | ((F.col("dense_share") > limit["dense_share"]) & (F.col("dense_alnum_share") < limit["alnum_share"]))
    )
    table = (F.col("table_share") > limit["table_share"]) & (F.col("number_share") > limit["number_share"])
    blob = (F.col("encoded_share") > limit["encoded_share"]) & ((F.col("alnum_share") > limit["encoded_alnum"]) | spaceless)
    repeated = F.col("repeat_share") > limit["repeat_share"]
    tool = head.rlike(_any(TOOL_MARKS)) & ~own
    vendored = F.col("_known").isNotNull() | F.col("_package").isNotNull() | (F.col("_noted").isNotNull() & ~own)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        F.col("id").alias("file_id"),
        "path",
        "true_language",
        "lines",
        "max_line",
        "mean_line",
        "space_share",
        "alnum_share",
        "number_share",
        "encoded_share",
        "table_share",
        "dense_share",
        "repeat_share",
        F.when(yes(blob | table), "data")
        .when(yes(minified) | F.col("_path").rlike(_any(BUNDLE_PATHS)), "minified")
        .when(yes(tool | repeated) | F.col("_path").rlike(_any(TOOL_PATHS)), "generated")
        .when(yes(vendored), "vendored")
        .otherwise("hand")
        .alias("origin"),
    )


def foreign_files(files: DataFrame, chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """file_id of each file that is not hand-written source."""
    return file_origins(files, chunks, upstream).where("origin <> 'hand'").select("file_id").distinct()
