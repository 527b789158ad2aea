"""Composite reports over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.predicates import days_between, is_stale, within_days
from kelpie.functions.scalars import cell
from kelpie.operators.lifecycle import orphans
from kelpie.operators.series import median_integer, running_total


def stats(tasks: DataFrame, log: DataFrame, tasks_now: Column, log_now: Column) -> DataFrame:
    """(section, label, n): tasks by status, stale facts, writes of the last week by action."""
    by_status = tasks.groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("section"), "label", "n")
    stale = tasks.agg(F.count_if(is_stale(F.col("verified_at"), tasks_now, 90)).alias("n")).select(F.lit("stale").alias("section"), F.lit("facts").alias("label"), "n")
    recent = log.where(within_days(F.col("at"), log_now, 7)).groupBy(F.col("action").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return by_status.unionByName(stale).unionByName(recent.select(F.lit("writes").alias("section"), "label", "n"))


def doctor(files: DataFrame, chunks: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(check_name, n): how many rows fail each check; 0 is healthy."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    keys = files.select(F.col("id").alias("file_id"))
    checks = [
        count(orphans(chunks.select("file_id"), keys, ["file_id"]), "orphan_chunks"),
        count(orphans(turns.select("session_id"), sessions, ["session_id"]), "orphan_turns"),
        count(orphans(keys, chunks, ["file_id"]), "files_without_chunks"),
        count(sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated_sessions"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def stale_queue(tasks: DataFrame, now: Column, horizon: int = 90, done_days: int = 30, show: int = 25) -> DataFrame:
    """(category, id, total): per category how many there are and the oldest `show`: stale facts that nothing
    replaced, tasks long done, expired proposals."""
    age = days_between(now, F.col("verified_at"))
    facts = tasks.where((F.col("status") == "open") & F.col("superseded_by").isNull() & is_stale(F.col("verified_at"), now, horizon))
    done = tasks.where((F.col("status") == "done") & (age > done_days))
    pending = tasks.where((F.col("status") == "blocked") & (F.col("verified_at") < now - F.make_interval(days=F.lit(done_days))))
    rows = [df.select(F.lit(name).alias("category"), "id", age.alias("age")) for name, df in (("fact", facts), ("task", done), ("pending", pending))]
    queue = rows[0].unionByName(rows[1]).unionByName(rows[2])
    totals = queue.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    oldest = Window.partitionBy("category").orderBy(F.desc_nulls_first("age"), "id")
    top = queue.withColumn("rn", F.row_number().over(oldest)).where(F.col("rn") <= show)
    return top.join(totals, "category").select("category", "id", "total")


def period_totals(sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """Per agent over the last days: sessions, input tokens, those of sessions with recalls, and the median
    baseline of sessions without."""
    recent = sessions.where(within_days(F.col("started_at"), now, days))
    without = F.when(F.col("recall_calls") == 0, F.col("baseline_input_tokens"))
    return recent.groupBy("agent").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum(F.when(F.col("recall_calls") > 0, F.col("input_tokens")).otherwise(0)).alias("with_recall"),
        median_integer(without).alias("baseline"),
    )


def ledger_lines(tasks: DataFrame, show: int) -> DataFrame:
    """(ord, line): a Markdown table of the first tasks, open ones first."""
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "blocked", 1).otherwise(2)
    top = tasks.orderBy(rank, "id").limit(show)  # then one partition holds `show` rows
    line = F.concat(F.lit("| "), F.col("id").cast("string"), F.lit(" | "), "status", F.lit(" | "), cell(F.col("source")), F.lit(" |"))
    return top.select(F.row_number().over(Window.orderBy(rank, "id")).alias("ord"), line.alias("line"))


def health(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n): how many rows fail each of some checks, given by the rows that fail."""
    out = None
    for name, failing in checks.items():
        row = failing.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def vector_checks(sources: DataFrame, vectors: DataFrame, dimension: int) -> dict[str, DataFrame]:
    """The checks of vectors (id, vector, content_hash) against their sources (id, content_hash): sources without
    a vector, vectors without a source, of the wrong length, or of an earlier text."""
    ids, stored = sources.select("id"), vectors.select("id")
    of_text = vectors.join(sources.select("id", F.col("content_hash").alias("_now")), "id")
    return {
        "missing_vectors": ids.join(stored, "id", "left_anti"),
        "orphan_vectors": stored.join(ids, "id", "left_anti"),
        "corrupt_vectors": vectors.where(F.coalesce(F.size("vector") != dimension, F.lit(True))),
        "drifted_vectors": of_text.where(~F.col("content_hash").eqNullSafe(F.col("_now"))),
    }


def stale_summary(candidates: DataFrame, group: str) -> DataFrame:
    """(group, stale_count, total_count, reason) of candidates with the flags missing, drift and corrupt.

    A vector of the wrong length is corrupt whatever its text's hash says. The reason names what occurs.
    """
    corrupt = F.col("corrupt")
    missing, drift = F.col("missing") & ~corrupt, F.col("drift") & ~corrupt & ~F.col("missing")
    counted = candidates.groupBy(group).agg(
        F.count_if(corrupt | missing | drift).alias("stale_count"), F.count(F.lit(1)).alias("total_count"),
        F.max(missing).alias("_m"), F.max(drift).alias("_d"), F.max(corrupt).alias("_c"),
    )
    named = F.array_join(F.array_compact(F.array(F.when(F.col("_m"), "missing"), F.when(F.col("_d"), "drift"), F.when(F.col("_c"), "corrupt"))), "_or_")
    reason = (
        F.when(F.col("_m") & F.col("_d") & F.col("_c"), "missing_drift_or_corrupt")
        .when(named == "missing", "missing_embeddings").when(named == "drift", "content_drift").when(named == "corrupt", "corrupt_length_mismatch")
        .otherwise(named)
    )
    return counted.select(group, "stale_count", "total_count", reason.alias("reason"))


def session_series(sessions: DataFrame, recalls: DataFrame, group: str) -> DataFrame:
    """Sessions (session_id, started_at, input_tokens, output_tokens, group) in order of their start, with running totals.

    `delta` is a session's tokens; its offset is what its recalls (session_id, bundle_tokens,
    ledger_tokens) spared: the smallest ledger less all bundles, at least 0, and 0 if no recall found
    anything. Negatives count as 0 in the totals.
    """
    found = F.col("bundle_tokens") > 0
    per = recalls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("recalls"), F.count_if(found).alias("_found"), F.min("ledger_tokens").alias("_ledger"), F.sum(F.when(found, F.col("bundle_tokens")).otherwise(0)).alias("_bundles")
    )
    spared = F.when(F.col("_found") > 0, F.greatest(F.lit(0), F.col("_ledger") - F.col("_bundles"))).otherwise(0)
    rows = sessions.join(per, "session_id", "left").select(
        "session_id", group, "started_at", (F.col("input_tokens") + F.col("output_tokens")).alias("delta"),
        F.coalesce(spared, F.lit(0)).alias("offset"), F.coalesce("recalls", F.lit(0)).alias("recalls"),
    )
    return running_total(rows, group, ["started_at", "session_id"], ["delta", "offset", "recalls"])


def page(parts: list[tuple[str, DataFrame]], title: str) -> DataFrame:
    """(ord, line) of a page: its title, then each part's heading and lines (ord, line) in order; a part without lines says so.

    Parts are limited by whoever makes them, so a page is small.
    """
    spark = parts[0][1].sparkSession
    out = spark.createDataFrame([(0, 0, f"# {title}")], "part int, ord int, line string")
    for number, (heading, lines) in enumerate(parts, 1):
        head = spark.createDataFrame([(number, -2, ""), (number, -1, f"## {heading}"), (number, 0, "")], "part int, ord int, line string")
        none = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(number).alias("part"), F.lit(1).alias("ord"), F.lit("_Nothing recorded._").alias("line"))
        out = out.unionByName(head).unionByName(lines.select(F.lit(number).alias("part"), F.col("ord").cast("int").alias("ord"), "line")).unionByName(none)
    return out.select(F.row_number().over(Window.orderBy("part", "ord")).alias("ord"), "line")


def narrative_lines(latest: DataFrame) -> DataFrame:
    """(ord, line) of the latest narrative (body, created_at, actor): the body without a heading of its own, then who wrote it when."""
    body = F.regexp_replace(F.regexp_replace("body", r"^\s*#{1,6} [^\n]*\n+", ""), r"\s+$", "")
    note = F.concat(F.lit("_Last updated "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" by "), "actor", F.lit("._"))
    return latest.limit(1).select(F.posexplode(F.concat(F.split(body, "\n"), F.array(F.lit(""), note))).alias("ord", "line")).select((F.col("ord") + 1).alias("ord"), "line")


def note_lines(notes: DataFrame, show: int) -> DataFrame:
    """(ord, line) of the newest notes (id, text, created_at, actor), each on one line."""
    newest = notes.orderBy(F.desc("created_at"), F.desc("id")).limit(show)
    line = F.concat(F.lit("- **"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("** ("), "actor", F.lit(") — "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return newest.select(F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("ord"), line.alias("line"))
