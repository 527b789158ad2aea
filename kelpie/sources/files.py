"""Files as rows: tracked files of a repository, bytes and stats, Markdown documents, settings, archives."""

from __future__ import annotations

import dataclasses
import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.predicates import DEFAULT_DENY, is_denied


def tracked_files(spark: SparkSession, repository: str, deny: list[str]) -> DataFrame:
    """(path) of a repository's tracked files without the denied ones, each once, in order."""
    out = subprocess.run(["git", "-C", repository, "ls-files", "-z"], capture_output=True, check=True).stdout
    paths = sorted({p.decode("utf-8", "replace") for p in out.split(b"\0") if p})
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.where(~is_denied(F.col("path"), deny)).distinct().orderBy("path")


def file_rows(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, mtime, size, content_hash, text) of the files below a folder; text is null for what isn't UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = Path(folder).resolve().as_posix().rstrip("/")
    path = F.regexp_replace("path", rf"^file:/*{root.lstrip('/')}/", "")
    return raw.select(
        path.alias("path"),
        F.unix_timestamp("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("content_hash"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, byte_len, content_hash, content): the first heading is the title, else the file's name."""
    rows = file_rows(spark, folder, "*.md").where("text is not null")
    heading = F.regexp_extract("text", r"(?m)^ {0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return rows.select("path", F.when(heading != "", heading).otherwise(name).alias("title"), F.col("size").alias("byte_len"), "content_hash", F.col("text").alias("content"))


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval, accounting and retention."""

    mode: str = "fts"
    accepted_only: bool = False
    include_stale: bool = True
    horizon_days: int = 90
    pool: int = 20
    max_results: int = 6
    text_weight: float = 0.5
    vector_weight: float = 0.5
    stale_penalty: float = 0.3
    superseded_penalty: float = 0.4
    age_half_life_days: int = 0
    use_reranker: bool = True
    min_rerank_score: float = 2.0
    doc_min_rerank_score: float = 0.0
    docs_by_default: bool = False
    code_text_weight: float = 0.5
    code_vector_weight: float = 0.5
    test_path_penalty: float = 0.9
    metrics: bool = False
    retention_days: int = 90
    calibration: float = 1.0
    global_store: bool = False
    sync: bool = False
    deny: tuple[str, ...] = field(default=tuple(DEFAULT_DENY))


def setting_problems(settings: Settings) -> list[str]:
    """What is out of range: names of the settings with what they must be."""
    share = ("text_weight", "vector_weight", "stale_penalty", "superseded_penalty", "code_text_weight", "code_vector_weight", "test_path_penalty")
    out = [f"{name} must be between 0 and 1" for name in share if not 0 <= getattr(settings, name) <= 1]
    out += [f"{name} must be above 0" for name in ("horizon_days", "pool", "max_results", "calibration") if getattr(settings, name) <= 0]
    out += [f"{name} must not be below 0" for name in ("age_half_life_days", "retention_days") if getattr(settings, name) < 0]
    return out + ([] if settings.mode in ("fts", "hybrid") else ["mode must be fts or hybrid"])


def load_settings(path: str) -> Settings:
    """Settings from a TOML file; unknown names and values of another type raise ValueError."""
    with open(path, "rb") as file:
        given = tomllib.load(file)
    known = {f.name: f for f in dataclasses.fields(Settings)}
    if extra := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    values = {}
    for name, value in given.items():
        default = getattr(Settings(), name)
        value = tuple(value) if isinstance(default, tuple) and isinstance(value, list) else float(value) if isinstance(default, float) and isinstance(value, int) else value
        if type(value) is not type(default):
            raise ValueError(f"{name} must be {type(default).__name__}")
        values[name] = value
    return Settings(**values)


def save_settings(settings: Settings, path: str) -> None:
    """Writes settings as TOML."""

    def literal(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, tuple):
            return "[" + ", ".join(literal(v) for v in value) + "]"
        return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else str(value)

    lines = [f"{f.name} = {literal(getattr(settings, f.name))}" for f in dataclasses.fields(settings)]
    Path(path).write_text("\n".join(lines) + "\n")


def archive_transcripts(lines: DataFrame, folder: str) -> DataFrame:
    """Writes raw lines as compressed text, one folder per session, and gives the catalogue of what was written."""
    lines.select("session_id", F.col("raw_line").alias("value")).write.mode("append").partitionBy("session_id").option("compression", "gzip").text(folder)
    return lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw_line") + 1).alias("bytes"))
