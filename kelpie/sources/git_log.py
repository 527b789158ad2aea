"""Version history as rows of commits and changed files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "commit%x1f%H%x1f%an%x1f%aI%x1f%s"


def parse_log(logs: DataFrame) -> DataFrame:
    """(sha, author, committed_at, message, change_type, path) of log texts (value).

    A text holds whole commits: a header line of five fields, then one line per changed file. It is cut
    into commits first, so no header is carried from row to row. A rename or copy counts under its new
    path. Author dates stay text, as they are compared as text; commits without files have no row.
    """
    blocks = logs.select(F.explode(F.split("value", "(?m)^(?=commit\x1f)")).alias("block")).where(F.startswith("block", F.lit("commit\x1f")))
    lines = blocks.select(F.split("block", "\n").alias("lines"))
    head = F.split(F.col("lines")[0], "\x1f")
    changes = lines.select(
        head[1].alias("sha"), head[2].alias("author"), head[3].alias("committed_at"), head[4].alias("message"),
        F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"),
    ).where(F.trim("line") != "")
    fields = F.split("line", "\t")
    kind = F.left(fields[0], F.lit(1))
    return changes.select("sha", "author", "committed_at", "message", kind.alias("change_type"), F.element_at(fields, -1).alias("path"))


def read_log(spark: SparkSession, repository: str, stretch: int = 500) -> DataFrame:
    """The history of a repository that all executors reach, read by git in stretches of so many commits.

    The driver lists the commits' names alone; each stretch is read by one task.
    """
    names = subprocess.run(["git", "-C", repository, "rev-list", "HEAD"], capture_output=True).stdout.decode().split()
    stretches = [("\n".join(names[i : i + stretch]),) for i in range(0, len(names), stretch)]
    command = ["git", "-C", repository, "log", "--no-walk=unsorted", "--stdin", "--name-status", "--find-renames", f"--format={FORMAT}"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wanted in batch["value"]:
                text = subprocess.run(command, input=wanted.encode(), capture_output=True, check=True).stdout
                yield pd.DataFrame({"value": [text.decode("utf-8", "replace")]})

    asked = spark.createDataFrame(stretches, "value string").repartition(max(1, len(stretches)))
    return parse_log(asked.mapInPandas(read, "value string"))


def head(repository: str) -> str | None:
    """The commit that is checked out; None without one."""
    found = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True)
    return found.stdout.decode().strip() or None if found.returncode == 0 else None
