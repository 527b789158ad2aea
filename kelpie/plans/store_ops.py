"""Table functions (J), lifecycle (K), incremental (L) and reports (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions.budget import approximate_tokens, budget_class
from kelpie.functions.predicates import blank_label, is_stale, language_of
from kelpie.operators import chunkers, joins, lifecycle, reports, series
from kelpie.plans.base import EVENTS_AS_OF, ORDERS_AS_OF, Family, events_now, orders_now
from kelpie.plans.relational import _ATTRIBUTED, LOG, RUNS, STALE_SQL, TASKS, _attributed
from kelpie.sources import transcripts

family = Family()
query = family.query


# --- J: table functions ----------------------------------------------------------------------------


@query("J01_markdown")
def _(t):
    return chunkers.explode_chunks(t.prepared_docs, "prep_id", ["content"], chunkers.markdown_chunks, "heading_path string, body string").select(
        "prep_id", "ord", "heading_path", F.char_length("body").cast("long").alias("size")
    )


@query("J03_line_windows", """
SELECT prep_id, k AS ord, k * 50 + 1 AS first_line, LEAST((k + 1) * 50, lines) AS last_line, LEAST((k + 1) * 50, lines) - k * 50 AS n_lines
FROM (SELECT prep_id, lines, unnest(range(0, (lines + 49) // 50)) AS k FROM (SELECT prep_id, len(string_split(content, chr(10))) AS lines FROM prepared_docs))""")
def _(t):
    return chunkers.fixed_windows(t.prepared_docs, "prep_id", "content")


@query("J03_sized_windows", """
WITH l AS (SELECT prep_id, i, octet_length(encode(lines[i])) + 1 AS w FROM (SELECT prep_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT prep_id, string_split(content, chr(10)) AS lines FROM prepared_docs)))
SELECT prep_id, SUM(CASE WHEN w > 4000 THEN 0 ELSE 1 END)::BIGINT AS plain_lines, 0 AS too_many_lines, 0 AS too_large, 0 AS lost FROM l GROUP BY prep_id HAVING COUNT(*) > 1 OR MAX(w) > 1""")
def _(t):
    # what holds of all windows: none has over 50 lines or 4,000 bytes, and together they are the text but for blank windows
    rows = chunkers.explode_chunks(t.prepared_docs, "prep_id", ["content"], chunkers.line_windows, "first_line long, last_line long, body string")
    windows = rows.groupBy("prep_id").agg(
        F.count_if(F.col("last_line") - F.col("first_line") >= 50).alias("too_many_lines"), F.count_if(F.octet_length("body") > 4000).alias("too_large"), F.sum(F.length(F.regexp_replace("body", r"\s", ""))).alias("kept")
    )
    lines = F.split("content", "\n")
    texts = t.prepared_docs.select("prep_id", F.size(F.filter(lines, lambda x: F.octet_length(x) < 4000)).cast("long").alias("plain_lines"), F.length(F.regexp_replace("content", r"\s", "")).alias("held"), F.length("content").alias("n"))
    joined = texts.where("n > 0").join(windows, "prep_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("prep_id", "plain_lines", none("too_many_lines").alias("too_many_lines"), none("too_large").alias("too_large"), (F.col("held") - none("kept")).alias("lost"))


@query("J04_ast")
def _(t):
    at = F.locate("\n\n", F.col("embed_text"))  # the first blank line ends the path; the body may have more
    body = F.when(at > 0, F.substring("embed_text", at + 2, F.length("embed_text"))).otherwise(F.col("embed_text"))
    bodies = t.code_chunks.select(F.col("id"), F.col("file_id"), body.alias("body"))
    files = t.indexed_files.select(F.col("id").alias("file_id"), language_of(F.col("path")).alias("language"))
    joined = bodies.join(files, "file_id")
    return chunkers.explode_chunks(joined, "id", ["body", "language"], chunkers.code_chunks, "kind string, symbol string, first_line long, last_line long, body string").drop("body")


_TURN_SQL = """
SELECT file_id, line_no, COALESCE(TRY_CAST(json_extract_string(j, '$.message.usage.input_tokens') AS BIGINT), TRY_CAST(json_extract_string(j, '$.usage.input_tokens') AS BIGINT), 0) AS input,
  COALESCE(TRY_CAST(json_extract_string(j, '$.message.usage.output_tokens') AS BIGINT), TRY_CAST(json_extract_string(j, '$.usage.output_tokens') AS BIGINT), 0) AS output
FROM (SELECT file_id, line_no, CASE WHEN json_valid(raw_line) THEN raw_line END AS j FROM (SELECT DISTINCT file_id, line_no, raw_line FROM transcript_lines))
WHERE json_extract(j, '$.message.usage') IS NOT NULL OR json_extract(j, '$.usage') IS NOT NULL"""


@query("J06_turn_records", _TURN_SQL)
def _(t):
    lines = t.transcript_lines.select("file_id", "line_no", "raw_line").distinct()
    return transcripts.message_usage(lines).select("file_id", "line_no", "input", "output")


@query("J07_log_rows", "SELECT 'M' AS change_type, COUNT(*) AS n, COUNT(DISTINCT path) AS paths FROM code_chunks JOIN indexed_files f ON f.id = file_id")
def _(t):
    from kelpie.sources.git_log import parse_log

    header = F.concat(F.lit("commit\x1f"), F.col("id").cast("string"), F.lit("\x1fdev\x1f2026-01-01T00:00:00+02:00\x1f"), "kind", F.lit("\n"))
    logs = t.code_chunks.join(t.indexed_files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.concat(header, F.lit("M\t"), "path").alias("value"))
    return parse_log(logs).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


@query("J08_suffixes", r"""
SELECT id, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[i:], '/'))) AS suffix FROM indexed_files""")
def _(t):
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return t.indexed_files.select("id", F.explode(suffixes).alias("suffix"))


# --- K: lifecycle ----------------------------------------------------------------------------------


@query("K01_upsert", """
SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT DISTINCT doc_id, 'updated' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id + 10000000, 'added' FROM documents WHERE doc_id % 100 = 0""")
def _(t):
    table = t.documents.select("doc_id", "source")
    changed = t.documents.where("doc_id % 5 = 0").select("doc_id", F.lit("updated").alias("source"))
    added = t.documents.where("doc_id % 100 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("added").alias("source"))
    return lifecycle.upsert(table, changed.unionByName(added), ["doc_id"])


@query("K02_additive_upsert", """
SELECT session_id, SUM(input_tokens)::BIGINT AS input_tokens, SUM(output_tokens)::BIGINT AS output_tokens, epoch_us(MIN(ts)) AS started, epoch_us(MAX(ts)) AS ended
FROM session_turn_metrics GROUP BY session_id""")
def _(t):
    turns = t.session_turn_metrics.select("id", "session_id", "input_tokens", "output_tokens", F.col("ts").alias("started"), F.col("ts").alias("ended"))
    per = lambda rows: rows.groupBy("session_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.min("started").alias("started"), F.max("ended").alias("ended")
    )
    table, delta = per(turns.where("id % 2 = 0")), per(turns.where("id % 2 = 1"))
    merged = lifecycle.add_up(table, delta, ["session_id"], ["input_tokens", "output_tokens"], ["started"], ["ended"])
    return merged.withColumns({"started": F.unix_micros("started"), "ended": F.unix_micros("ended")})


@query("K03_debounced", f"""
SELECT actor, epoch_us(MAX(CASE WHEN second THEN tm END)) AS seen FROM (SELECT actor, MIN(tm) AS tm, FALSE AS second FROM {LOG} GROUP BY actor) a GROUP BY actor HAVING FALSE
UNION ALL SELECT actor, epoch_us(CASE WHEN MAX(tm) >= MIN(tm) + INTERVAL 15 DAY THEN MAX(tm) ELSE MIN(tm) END) AS seen FROM {LOG} GROUP BY actor""")
def _(t):
    first = t.log.groupBy("actor").agg(F.min("at").alias("seen"))
    latest = t.log.groupBy("actor").agg(F.max("at").alias("seen"))
    kept = lifecycle.upsert_where(first, latest, "actor", "seen", F.expr("interval 15 days"))
    return kept.select("actor", F.unix_micros("seen").alias("seen"))


@query("K04_prior_value_audit", "SELECT doc_id, source AS old_value, 'task' AS new_value FROM documents WHERE doc_id % 9 = 0 AND source <> 'task'")
def _(t):
    edits = t.documents.where("doc_id % 9 = 0").select("doc_id", F.lit("task").alias("new_value"))
    prior = t.documents.select("doc_id", F.col("source").alias("old_value"))
    return edits.join(prior, "doc_id").where("old_value <> new_value").select("doc_id", "old_value", "new_value")


@query("K05_touch", f"SELECT id, CASE WHEN {STALE_SQL} AND id % 2 <> 0 THEN 1 ELSE 0 END AS stale FROM {TASKS}")
def _(t):
    touched = t.tasks.withColumn("verified_at", F.when(F.col("id") % 2 == 0, orders_now()).otherwise(F.col("verified_at")))
    return touched.select("id", is_stale(F.col("verified_at"), orders_now(), 90).cast("int").alias("stale"))


@query("K06_supersede", f"""
SELECT a.id, b.id AS superseded_by, CASE WHEN b.id IS NOT NULL THEN 'superseded' ELSE a.status END AS status
FROM {TASKS} a LEFT JOIN {TASKS} b ON a.id % 7 = 0 AND b.id = a.id + 1""")
def _(t):
    table = t.tasks.select("id", F.lit(None).cast("long").alias("superseded_by"), "status")
    links = t.tasks.where("superseded_by is not null").select("id", "superseded_by").unionByName(t.tasks.select("id", F.col("id").alias("superseded_by")))
    return lifecycle.supersede(table, links, "id", "status")


@query("K07_run_counter", f"""
SELECT kind, cmdline, COUNT(*) FILTER (WHERE success) AS successes, COUNT(*) FILTER (WHERE NOT success) AS failures, epoch_us(MAX(run_at)) AS last_run_at FROM {RUNS} GROUP BY 1, 2""")
def _(t):
    return t.runs.groupBy("kind", "cmdline").agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.unix_micros(F.max("run_at")).alias("last_run_at")
    )


@query("K10_replay_marker", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 8 = 0)")
def _(t):
    markers = t.documents.where("doc_id % 8 = 0").select("doc_id")
    return t.documents.where("doc_id % 4 = 0").select("doc_id").join(markers, "doc_id", "left_anti")


@query("K11_expire", f"""
SELECT id, CASE WHEN status = 'blocked' AND verified_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY THEN 'expired' WHEN status = 'blocked' THEN 'pending' ELSE status END AS status FROM {TASKS}""")
def _(t):
    status = F.when(F.col("status") == "blocked", "pending").otherwise(F.col("status"))
    pending = t.tasks.select("id", status.alias("status"), F.col("verified_at").alias("created_at"))
    return lifecycle.expire(pending, orders_now() - F.expr("interval 30 days")).select("id", "status")


@query("K12_cascade", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source <> 'commit')")
def _(t):
    left = t.documents.where("source <> 'commit'").select(F.col("doc_id").alias("vec_id"))
    gone = lifecycle.orphans(t.embeddings.select("vec_id"), left, ["vec_id"])
    return t.embeddings.select("vec_id").join(gone, "vec_id", "left_anti")


@query("K13_retention", "SELECT session_id, started_at::VARCHAR IS NOT NULL AS kept FROM session_metrics WHERE ended_at IS NULL OR started_at IS NULL OR started_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00'")
def _(t):
    kept = lifecycle.keep_recent(t.session_metrics, "started_at", F.lit("2026-01-01 00:00:00").cast("timestamp"), 90, "ended_at")
    return kept.select("session_id", F.col("started_at").isNotNull().alias("kept"))


@query("K14_ingest_class", "SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS class FROM documents")
def _(t):
    now = t.documents.select("path", "content_hash", F.lit(1).alias("stamp"))
    before = t.documents.where("doc_id % 7 <> 0").select(
        "path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(0).alias("stamp")
    )
    named = F.when(F.col("change") == "new", "created").when(F.col("change") == "changed", "updated").otherwise("unchanged")
    return joins.change_classes(now, before, "path", "content_hash", "stamp").select("path", named.alias("class"))


@query("K15_audit_append", f"SELECT action, COUNT(*) AS n FROM (SELECT action FROM {LOG} UNION ALL SELECT 'render' FROM documents) GROUP BY action")
def _(t):
    appended = t.log.select("action").unionByName(t.documents.select(F.lit("render").alias("action")))
    return appended.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("K17_latest_narrative", "SELECT project_id, arg_max(doc_id, (ingested_at, doc_id)) AS latest, COUNT(*) AS versions FROM documents WHERE source = 'session_note' AND ingested_at IS NOT NULL GROUP BY project_id")
def _(t):
    notes = t.documents.where("source = 'session_note' and ingested_at is not null")
    return notes.groupBy("project_id").agg(F.max(F.struct("ingested_at", "doc_id"))["doc_id"].alias("latest"), F.count(F.lit(1)).alias("versions"))


@query("K18_promote", "SELECT 'global' AS scope, doc_id FROM documents WHERE source = 'fact' UNION ALL SELECT 'repo', doc_id FROM documents")
def _(t):
    promoted = t.documents.where("source = 'fact'").select(F.lit("global").alias("scope"), "doc_id")
    return promoted.unionByName(t.documents.select(F.lit("repo").alias("scope"), "doc_id"))


# --- L: incremental --------------------------------------------------------------------------------


@query("L03_shrink_reset", """
SELECT CASE WHEN file_id % 4 = 0 THEN 'reset' ELSE 'resume' END AS state, COUNT(*) AS n FROM transcript_files WHERE line_count IS NOT NULL GROUP BY 1
UNION ALL SELECT 'resume', COUNT(*) FROM transcript_files WHERE line_count IS NULL HAVING COUNT(*) > 0""")
def _(t):
    files = t.transcript_files.select("file_id", "line_count", F.when(F.col("file_id") % 4 == 0, F.col("line_count") + 5).otherwise(F.col("line_count") - 1).alias("scanned"))
    state = F.when(F.col("line_count") < F.col("scanned"), "reset").when(F.col("line_count") == F.col("scanned"), "skip").otherwise("resume")
    return files.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("L04_stateful_totals", "SELECT session_id, COUNT(*) AS turns, SUM(input_tokens)::BIGINT AS input_tokens, SUM(output_tokens)::BIGINT AS output_tokens FROM session_turn_metrics GROUP BY session_id")
def _(t):
    from kelpie.streaming.sessions import stream_session_totals

    return stream_session_totals(t.spark, f"{t.sf_dir}/session_turn_metrics.parquet")


@query("L05_bad_lines", """
SELECT file_id, COUNT(*) AS lines, COUNT(*) FILTER (WHERE trim(raw_line) <> '' AND NOT (json_valid(trim(raw_line)) AND starts_with(trim(raw_line), '{'))) AS skips
FROM (SELECT DISTINCT file_id, line_no, raw_line FROM transcript_lines) GROUP BY file_id""")
def _(t):
    lines = t.transcript_lines.select("file_id", "line_no", "raw_line").distinct()
    return lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(transcripts.is_damaged(F.col("raw_line"))).alias("skips"))


@query("L06_late_attribution", f"SELECT v.id, a.session FROM {LOG} v LEFT JOIN ({_ATTRIBUTED}) a ON a.event_id = v.id WHERE v.action = 'view'")
def _(t):
    views = t.log.where("action = 'view'").select("id")
    return views.join(_attributed(t).withColumnRenamed("event_id", "id"), "id", "left").select("id", "session")


@query("L07_open_cap", "SELECT session_id, epoch_us(COALESCE(ended_at, started_at + INTERVAL 12 HOUR)) AS closes FROM session_metrics")
def _(t):
    return t.session_metrics.select("session_id", F.unix_micros(F.coalesce("ended_at", F.col("started_at") + F.expr("interval 12 hours"))).alias("closes"))


@query("L09_since_id", f"SELECT id, action FROM {LOG} WHERE id > 700")
def _(t):
    return t.log.where("id > 700").select("id", "action")


@query("L10_incremental", """
SELECT change, COUNT(*) AS files FROM (SELECT CASE WHEN id % 11 = 0 THEN 'new' WHEN id % 5 = 0 AND content_hash <> 'x' THEN 'changed' ELSE 'unchanged' END AS change FROM indexed_files) GROUP BY change""")
def _(t):
    now = t.indexed_files.select("path", "content_hash", F.col("content_hash").alias("stamp"))
    before = t.indexed_files.where("id % 11 <> 0").select("path", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"))
    return joins.change_classes(now, before.withColumn("stamp", F.col("content_hash")), "path", "content_hash", "stamp").groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query("L11_verdict", """
SELECT doc_id, CASE WHEN l IS NOT DISTINCT FROM r THEN 'up-to-date' WHEN r IS NULL THEN 'no-remote' WHEN r IS NOT DISTINCT FROM b THEN 'ahead' WHEN l IS NOT DISTINCT FROM b THEN 'behind' ELSE 'diverged' END AS verdict
FROM (SELECT doc_id, content_hash AS l, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'r' ELSE content_hash END AS r, CASE WHEN doc_id % 2 = 0 THEN content_hash WHEN doc_id % 9 = 0 THEN 'r' ELSE 'b' END AS b FROM documents)""")
def _(t):
    own = F.col("content_hash")
    remote = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "r").otherwise(own)
    base = F.when(F.col("doc_id") % 2 == 0, own).when(F.col("doc_id") % 9 == 0, "r").otherwise("b")
    return t.documents.select("doc_id", lifecycle.sync_verdict(own, remote, base).alias("verdict"))


# --- N: reports ------------------------------------------------------------------------------------


@query("N02_locate_eval", """
SELECT COUNT(*) AS queries, SUM(CASE WHEN best = 1 THEN 1 ELSE 0 END)::BIGINT AS at_1, SUM(CASE WHEN best <= 3 THEN 1 ELSE 0 END)::BIGINT AS at_3
FROM (SELECT query_id, MIN(hit_rank) FILTER (WHERE score >= 0.3) AS best FROM locate_hits GROUP BY query_id)""")
def _(t):
    best = t.locate_hits.groupBy("query_id").agg(F.min(F.when(F.col("score") >= 0.3, F.col("hit_rank"))).alias("best"))
    return best.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("best") == 1).alias("at_1"), F.count_if(F.col("best") <= 3).alias("at_3"))


@query("N03_stats", f"""
SELECT 'status' AS section, status AS label, COUNT(*) AS n FROM {TASKS} GROUP BY status UNION ALL SELECT 'stale', 'facts', COUNT(*) FROM {TASKS} WHERE {STALE_SQL}
UNION ALL SELECT 'writes', action, COUNT(*) FROM {LOG} WHERE tm >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY action""")
def _(t):
    return reports.stats(t.tasks, t.log, orders_now(), events_now())


@query("N04_status", "SELECT project_id, COUNT(*) AS documents, COUNT(*) FILTER (WHERE lang IS NULL) AS unknown_lang, epoch_us(MAX(ingested_at)) AS latest FROM documents GROUP BY project_id")
def _(t):
    return t.documents.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("lang").isNull()).alias("unknown_lang"), F.unix_micros(F.max("ingested_at")).alias("latest")
    )


@query("N05_doctor", """
SELECT 'orphan_chunks' AS check_name, COUNT(*) AS n FROM code_chunks WHERE file_id NOT IN (SELECT id FROM indexed_files)
UNION ALL SELECT 'orphan_turns', COUNT(*) FROM session_turn_metrics WHERE session_id NOT IN (SELECT session_id FROM session_metrics)
UNION ALL SELECT 'files_without_chunks', COUNT(*) FROM indexed_files WHERE id NOT IN (SELECT file_id FROM code_chunks)
UNION ALL SELECT 'repeated_sessions', COUNT(*) FROM (SELECT session_id FROM session_metrics GROUP BY 1 HAVING COUNT(*) > 1)""")
def _(t):
    return reports.doctor(t.indexed_files, t.code_chunks, t.session_metrics, t.session_turn_metrics)


@query("N06_stale_queue", f"""
SELECT category, id, total FROM (SELECT category, id, COUNT(*) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY age DESC, id) AS rn FROM (
  SELECT 'fact' AS category, id, epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at) AS age FROM {TASKS} WHERE status = 'open' AND superseded_by IS NULL AND {STALE_SQL}
  UNION ALL SELECT 'task', id, epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at) FROM {TASKS} WHERE status = 'done' AND epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at) > 30 * 86400000000
  UNION ALL SELECT 'pending', id, epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at) FROM {TASKS} WHERE status = 'blocked' AND verified_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY)) WHERE rn <= 25""")
def _(t):
    return reports.stale_queue(t.tasks, orders_now())


@query("N07_period_totals", """
SELECT agent, COUNT(*) AS sessions, SUM(input_tokens)::BIGINT AS input_tokens, SUM(CASE WHEN recall_calls > 0 THEN input_tokens ELSE 0 END)::BIGINT AS with_recall,
  CAST(trunc(median(baseline_input_tokens) FILTER (WHERE recall_calls = 0)) AS BIGINT) AS baseline
FROM session_metrics WHERE started_at >= TIMESTAMPTZ '2026-06-01 00:00:00+00' - INTERVAL 30 DAY GROUP BY agent""")
def _(t):
    return reports.period_totals(t.session_metrics, F.lit("2026-06-01 00:00:00").cast("timestamp"), 30)


@query("N08_series", """
SELECT id, SUM(GREATEST(input_tokens, 0)) OVER w::BIGINT AS total_input_tokens, i + MAX(x - i) OVER w AS x_strict, SUM(CASE WHEN nth = 1 AND good THEN cache_read_tokens ELSE 0 END) OVER w::BIGINT AS counterfactual
FROM (SELECT *, epoch_us(ts) // 1000000 AS x, cache_read_tokens > 1000 AS good, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i,
  row_number() OVER (PARTITION BY session_id, cache_read_tokens > 1000 ORDER BY id) AS nth FROM session_turn_metrics) WINDOW w AS (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    turns = t.session_turn_metrics.select("id", "session_id", "input_tokens", "cache_read_tokens", F.expr("unix_micros(ts) div 1000000").alias("x"))
    found = series.turn_series(turns, "session_id", "id", "x", "input_tokens", F.col("cache_read_tokens") > 1000, "cache_read_tokens")
    return found.select("id", "total_input_tokens", "x_strict", "counterfactual")


@query("N09_recent_sessions", "SELECT session_id, agent, input_tokens + output_tokens AS tokens FROM session_metrics ORDER BY started_at DESC, session_id, last_scanned_offset DESC NULLS LAST, input_tokens LIMIT 20")
def _(t):
    order = [F.desc("started_at"), F.col("session_id"), F.desc_nulls_last("last_scanned_offset"), F.col("input_tokens")]
    return t.session_metrics.orderBy(*order).limit(20).select("session_id", "agent", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


@query("N10_overview", """
SELECT 'lang' AS facet, COALESCE(NULLIF(lang, ''), '(blank)') AS label, COUNT(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY source
UNION ALL SELECT 'language', COALESCE(NULLIF(language, ''), '(blank)'), COUNT(*) FROM indexed_files GROUP BY 2""")
def _(t):
    facet = lambda df, name, c: df.groupBy(blank_label(F.col(c)).alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "label", "n")
    return facet(t.documents, "lang", "lang").unionByName(facet(t.documents, "source", "source")).unionByName(facet(t.indexed_files, "language", "language"))


@query("N11_ledger", f"""
SELECT ord, line FROM (SELECT row_number() OVER (ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'blocked' THEN 1 ELSE 2 END, id) AS ord, '| ' || id || ' | ' || status || ' | ' || replace(source, '|', '\\|') || ' |' AS line
FROM {TASKS} WHERE superseded_by IS NOT NULL) WHERE ord <= 100""")
def _(t):
    return reports.ledger_lines(t.tasks.where("superseded_by is not null"), 100)


@query("N12_diff", f"""
SELECT action, COUNT(*) AS n, COUNT(DISTINCT actor) AS row_ids, MIN(id) AS first_id, arg_max(props, id) AS latest_reason FROM {LOG} WHERE id > (SELECT MAX(event_id) // 2 FROM events) GROUP BY action""")
def _(t):
    middle = t.log.agg(F.expr("max(id) div 2").alias("since")).withColumn("_one", F.lit(1))
    fresh = t.log.withColumn("_one", F.lit(1)).join(middle, "_one").where("id > since")
    return fresh.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("row_ids"), F.min("id").alias("first_id"), F.max_by("props", "id").alias("latest_reason")
    )


@query("N13_index_status", "SELECT label, COUNT(*) AS vectors, COUNT(d.doc_id) AS current FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id GROUP BY label")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("d"))
    return t.embeddings.select("vec_id", "label").join(docs, "vec_id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count("d").alias("current"))


@query("N14_budget", """
SELECT prep_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, CASE WHEN ceil(length(content) / 4.0) > 1500 THEN 'fail' WHEN ceil(length(content) / 4.0) > 800 THEN 'warn' ELSE 'ok' END AS class FROM prepared_docs""")
def _(t):
    tokens = approximate_tokens(F.col("content"))
    return t.prepared_docs.select("prep_id", tokens.alias("tokens"), budget_class(tokens, 800, 1500).alias("class"))


@query("N15_doc_counts", "SELECT f.id AS file_id, f.path, COUNT(c.id) AS chunks FROM indexed_files f LEFT JOIN code_chunks c ON c.file_id = f.id GROUP BY 1, 2")
def _(t):
    counted = t.code_chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    return t.indexed_files.select(F.col("id").alias("file_id"), "path").join(counted, "file_id", "left").select("file_id", "path", F.coalesce("chunks", F.lit(0)).alias("chunks"))


# --- review, registry, embedding and further reports ------------------------------------------------


def _queue(t):
    """Documents as proposed facts: the title is the key; some are decided already, some lack a key."""
    payload = F.to_json(F.struct(F.col("title").alias("key"), F.when(F.col("doc_id") % 3 == 0, F.col("content_hash")).otherwise(F.lit("v")).alias("value")))
    return t.documents.where("source in ('decision', 'fact')").select(
        F.col("doc_id").alias("id"), F.lit("fact").alias("kind"), payload.alias("payload_json"), F.lit("why").alias("rationale"), F.when(F.col("doc_id") % 7 == 0, "rejected").otherwise("pending").alias("status"),
        F.lit("agent:x").alias("actor"), F.col("ingested_at").alias("created_at"), F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def _known_facts(t):
    first = t.documents.where("source = 'fact' and title is not null").groupBy(F.col("title").alias("key")).agg(F.min("doc_id").alias("id"), F.min_by("content_hash", "doc_id").alias("value"))
    return first.select("id", "key", "value", F.lit("user").alias("source"), F.lit(None).cast("long").alias("superseded_by"))


_REVIEW_SQL = """
f AS (SELECT title AS key, MIN(doc_id) AS id, arg_min(content_hash, doc_id) AS value FROM documents WHERE title IS NOT NULL AND source = 'fact' GROUP BY title),
p AS (SELECT doc_id AS id, title AS key, CASE WHEN doc_id % 3 = 0 THEN content_hash ELSE 'v' END AS value, doc_id % 7 <> 0 AS open FROM documents WHERE source IN ('decision', 'fact')),
g AS (SELECT key, arg_min(value, id) AS value FROM p WHERE open AND key IS NOT NULL GROUP BY key),
o AS (SELECT p.*, f.id AS fact_id, CASE WHEN NOT open THEN 'not_pending' WHEN p.key IS NULL THEN 'invalid' WHEN p.value = COALESCE(f.value, g.value) THEN 'accepted' ELSE 'conflict' END AS outcome
  FROM p LEFT JOIN f ON f.key = p.key LEFT JOIN g ON g.key = p.key)"""


@query("K08_propose", """
SELECT COUNT(*) AS proposed, COUNT(DISTINCT doc_id) AS ids, (SELECT MAX(doc_id) FROM documents WHERE source IN ('decision', 'fact')) + COUNT(*) AS last_id FROM documents
WHERE doc_id % 5 = 0 AND title IS NOT NULL AND trim(title) <> '' AND source = 'task'""")
def _(t):
    from kelpie.operators import review

    proposals = t.documents.where("doc_id % 5 = 0 and source = 'task'").select(
        F.col("doc_id").alias("seq"), F.lit("fact").alias("kind"), F.col("title").alias("key"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("target"),
        F.lit("because").alias("rationale"), F.lit("agent:x").alias("actor"),
    )
    queue = _queue(t)
    added = review.propose(queue, proposals, events_now()).where("rationale = 'because'")
    return added.agg(F.count(F.lit(1)).alias("proposed"), F.count_distinct("id").alias("ids"), F.max("id").alias("last_id"))


@query("K09_accept", f"WITH {_REVIEW_SQL} SELECT id, outcome, CASE WHEN outcome = 'conflict' THEN fact_id END AS conflict_id FROM o")
def _(t):
    from kelpie.operators import review

    queue = _queue(t)
    return review.accept(_known_facts(t), queue, queue.select("id"), events_now()).outcomes


@query("K09_accepted_facts", f"""
WITH {_REVIEW_SQL}, a AS (SELECT key, ANY_VALUE(value) AS value, ANY_VALUE(fact_id) AS fact_id FROM o WHERE outcome = 'accepted' GROUP BY key)
SELECT key, value, 'user+agent:x' AS source, fact_id IS NULL AS added FROM a UNION ALL SELECT key, value, 'user', FALSE FROM f WHERE key NOT IN (SELECT key FROM a)""")
def _(t):
    from kelpie.operators import review

    queue, known = _queue(t), _known_facts(t)
    facts = review.accept(known, queue, queue.select("id"), events_now()).facts
    return facts.join(known.select("id", F.lit(False).alias("old")), "id", "left").select("key", "value", "source", F.col("old").isNull().alias("added"))


@query("I16_probe", r"""
WITH w AS (SELECT doc_id AS id, title AS key, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda x: x <> '')) AS ws FROM documents WHERE title IS NOT NULL),
c AS (SELECT * FROM w ORDER BY id DESC LIMIT 200),
s AS (SELECT q.id AS query_id, c.id, len(list_intersect(q.ws, c.ws)) / len(q.ws) AS score FROM (SELECT * FROM w WHERE id % 50 = 0 AND len(ws) > 0) q JOIN c ON c.key <> q.key)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rn FROM s) WHERE rn = 1 AND score >= 0.5""")
def _(t):
    from kelpie.operators import rerank, review

    titled = t.documents.where("title is not null").select(F.col("doc_id").alias("id"), F.col("title").alias("key"), F.col("title").alias("text"))
    incoming = titled.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return review.probe(incoming, titled, rerank.LexicalOverlap(), threshold=0.5).select("query_id", "id", F.round("score", 6).alias("score"))


@query("I11_stale_reasons", """
SELECT source, COUNT(*) FILTER (WHERE missing OR drift) AS stale_count, COUNT(*) AS total_count,
  CASE WHEN bool_or(missing) AND bool_or(drift) THEN 'missing_or_drift' WHEN bool_or(missing) THEN 'missing_embeddings' WHEN bool_or(drift) THEN 'content_drift' ELSE '' END AS reason
FROM (SELECT source, vec_id IS NULL AS missing, vec_id IS NOT NULL AND content_hash <> sha256(text) AS drift FROM documents LEFT JOIN embeddings ON vec_id = doc_id) GROUP BY source""")
def _(t):
    stored = t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.size("embedding") != 64).alias("corrupt"))
    drift = F.col("content_hash") != F.sha2(F.encode("text", "UTF-8"), 256)
    flagged = t.documents.join(stored, "doc_id", "left").select("source", F.col("corrupt").isNull().alias("missing"), F.coalesce(drift, F.lit(False)).alias("drift"), F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
    return reports.stale_summary(flagged, "source")


@query("H21_vector_bytes", "SELECT vec_id, 4 * len(embedding) AS n_bytes, TRUE AS same FROM embeddings")
def _(t):
    from kelpie.operators import embedding

    packed = embedding.with_bytes(t.embeddings.select("vec_id", "embedding"), "embedding")
    back = embedding.with_vector(packed, "blob", "again")
    return back.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (F.col("embedding") == F.col("again")).alias("same"))


@query("H25_comment_strip", r"""
SELECT id, sha256(array_to_string(list_transform(string_split(embed_text, chr(10)), lambda l: array_to_string(list_transform(range(1, len(string_split(l, '"')) + 1),
  lambda i: CASE WHEN i % 2 = 0 OR NOT contains(string_split(l, '"')[i], '//') THEN string_split(l, '"')[i] ELSE split_part(string_split(l, '"')[i], '//', 1) || chr(1) END), '"')), chr(10))
  .regexp_replace('\x01[^\n]*', '', 'g')) AS digest FROM code_chunks""")
def _(t):
    from kelpie.functions.jsonc import strip_line_comments

    return t.code_chunks.select("id", F.sha2(F.encode(strip_line_comments(F.col("embed_text")), "UTF-8"), 256).alias("digest"))


@query("I17_embed", r"SELECT doc_id, 64 AS dimension, regexp_matches(text, '[\p{L}\p{N}]') AS unit FROM documents")
def _(t):
    from kelpie.operators import embedding

    vectors = embedding.embed(t.documents.select("doc_id", "text"), "doc_id", "text", embedding.HashedWords(64))
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return vectors.select("doc_id", F.size("vector").alias("dimension"), (length > 0.99).alias("unit"))


_SEEN = "TIMESTAMPTZ '2026-05-01 00:00:00+00'"


def _seen():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


@query("A03_registry", f"""
WITH r AS (SELECT 'p' || project_id AS root_path, MAX(ingested_at) AS last_seen FROM documents WHERE project_id % 3 <> 0 GROUP BY project_id),
o AS (SELECT DISTINCT 'p' || project_id AS root_path, CASE WHEN project_id % 4 = 0 THEN '4' ELSE '3' END AS last_schema, project_id % 5 <> 0 AS live FROM prepared_docs),
u AS (SELECT o.root_path, epoch_us(CASE WHEN r.root_path IS NULL OR o.last_schema <> '3' OR r.last_seen IS NULL OR r.last_seen < {_SEEN} - INTERVAL 1 HOUR THEN {_SEEN} ELSE r.last_seen END) AS last_seen,
  CASE WHEN r.root_path IS NULL OR o.last_schema <> '3' THEN o.last_schema ELSE '3' END AS last_schema FROM o LEFT JOIN r USING (root_path))
SELECT u.* FROM u JOIN o USING (root_path) WHERE live""")
def _(t):
    from kelpie.sources import registry

    root = F.concat(F.lit("p"), F.col("project_id").cast("string"))
    known = t.documents.where("project_id % 3 <> 0").groupBy(root.alias("root_path")).agg(F.max("ingested_at").alias("last_seen")).withColumn("last_schema", F.lit("3"))
    opened = t.prepared_docs.select(root.alias("root_path"), F.when(F.col("project_id") % 4 == 0, "4").otherwise("3").alias("last_schema"))
    live = t.prepared_docs.where("project_id % 5 <> 0").select(root.alias("root_path"))
    kept = registry.prune(registry.register(known, opened, _seen()), live)
    return kept.select("root_path", F.unix_micros("last_seen").alias("last_seen"), "last_schema")


@query("L08_hourly_claim", f"SELECT project_id, MAX(ended_at) IS NULL OR MAX(ended_at) < {_SEEN} - INTERVAL 1 HOUR AS claimed FROM session_metrics GROUP BY project_id")
def _(t):
    from kelpie.sources import registry

    last = t.session_metrics.groupBy("project_id").agg(F.max("ended_at").alias("last_run"))
    return last.select("project_id", registry.may_run(F.col("last_run"), _seen()).alias("claimed"))


@query("N05_vector_doctor", """
SELECT 'missing_vectors' AS check_name, COUNT(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'orphan_vectors', COUNT(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'corrupt_vectors', COUNT(*) FROM embeddings WHERE len(embedding) <> 64 OR embedding IS NULL
UNION ALL SELECT 'drifted_vectors', COUNT(*) FROM embeddings JOIN documents ON doc_id = vec_id WHERE content_hash <> sha256(text)
UNION ALL SELECT 'unindexed_texts', COUNT(*) FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 'settings', 0""")
def _(t):
    from kelpie.sources.files import Settings, setting_problems

    sources = t.documents.select(F.col("doc_id").alias("id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    hashed = t.documents.select(F.col("doc_id").alias("vec_id"), "content_hash")
    vectors = t.embeddings.join(hashed, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "content_hash")
    wrong = t.spark.createDataFrame([(p,) for p in setting_problems(Settings())], "problem string")
    unindexed = t.documents.where("text is null or trim(text) = ''")
    return reports.health({**reports.vector_checks(sources, vectors, 64), "unindexed_texts": unindexed, "settings": wrong})


@query("N08_by_session", """
WITH s AS (SELECT session_id, MIN(agent) AS agent, MIN(started_at) AS started_at, SUM(input_tokens) AS i, SUM(output_tokens) AS o FROM session_metrics GROUP BY session_id),
r AS (SELECT session_id, COUNT(*) AS recalls, COUNT(*) FILTER (WHERE cache_creation_tokens > 0) AS found, MIN(cache_read_tokens) AS ledger, SUM(CASE WHEN cache_creation_tokens > 0 THEN cache_creation_tokens ELSE 0 END) AS bundles
  FROM session_turn_metrics GROUP BY session_id),
x AS (SELECT s.session_id, agent, started_at, i + o AS delta, CASE WHEN COALESCE(found, 0) > 0 THEN GREATEST(0, ledger - bundles) ELSE 0 END AS spared, COALESCE(recalls, 0) AS recalls FROM s LEFT JOIN r USING (session_id))
SELECT session_id, delta::BIGINT AS delta, SUM(GREATEST(delta, 0)) OVER w::BIGINT AS total_delta, SUM(GREATEST(COALESCE(spared, 0), 0)) OVER w::BIGINT AS total_offset, SUM(recalls) OVER w::BIGINT AS total_recalls
FROM x WINDOW w AS (PARTITION BY agent ORDER BY started_at, session_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    sessions = t.session_metrics.groupBy("session_id").agg(
        F.min("agent").alias("agent"), F.min("started_at").alias("started_at"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    recalls = t.session_turn_metrics.select("session_id", F.col("cache_creation_tokens").alias("bundle_tokens"), F.col("cache_read_tokens").alias("ledger_tokens"))
    return reports.session_series(sessions, recalls, "agent").select("session_id", "delta", "total_delta", "total_offset", "total_recalls")


@query("N11_project_page", r"""
WITH n AS (SELECT doc_id, ingested_at, row_number() OVER (ORDER BY ingested_at DESC, doc_id DESC) AS k, '- **' || strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '** (project ' || project_id || ') — ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS line
  FROM documents WHERE source = 'session_note' AND ingested_at IS NOT NULL)
SELECT row_number() OVER (ORDER BY part, k) AS ord, line FROM (
  SELECT 0 AS part, 0 AS k, '# Project' AS line UNION ALL SELECT 1, -2, '' UNION ALL SELECT 1, -1, '## Recent session notes' UNION ALL SELECT 1, 0, '' UNION ALL SELECT 1, k, line FROM n WHERE k <= 10
  UNION ALL SELECT 2, -2, '' UNION ALL SELECT 2, -1, '## Open questions' UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, '_Nothing recorded._')""")
def _(t):
    notes = t.documents.where("source = 'session_note' and ingested_at is not null").select(
        F.col("doc_id").alias("id"), "text", F.col("ingested_at").alias("created_at"), F.concat(F.lit("project "), F.col("project_id").cast("string")).alias("actor")
    )
    lines = reports.note_lines(notes, 10)
    return reports.page([("Recent session notes", lines), ("Open questions", lines.where("ord < 0"))], "Project")


QUERIES, SQL = family.QUERIES, family.SQL
