"""Window functions (E) and scalar functions (H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions.predicates import days_between, language_of
from kelpie.functions.scalars import age_decay, cell, clamp01, clip, cosine, embed_text, min_max, slug, snippet, tokens
from kelpie.operators import series
from kelpie.plans.base import ORDERS_AS_OF, Family, orders_now
from kelpie.plans.relational import LOG, RUNS, TASKS

family = Family()
query = family.query


# --- E: window functions ---------------------------------------------------------------------------


@query("E01_rank", "SELECT query_id, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM locate_hits")
def _(t):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id")
    return t.locate_hits.select("query_id", "hit_id", F.row_number().over(w).alias("rank"))


@query("E02_running_totals", """
SELECT id, SUM(GREATEST(COALESCE(input_tokens, 0), 0)) OVER w::BIGINT AS total_input_tokens, SUM(GREATEST(COALESCE(output_tokens, 0), 0)) OVER w::BIGINT AS total_output_tokens
FROM session_turn_metrics WINDOW w AS (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    totals = series.running_total(t.session_turn_metrics.select("id", "session_id", "input_tokens", "output_tokens"), "session_id", ["id"], ["input_tokens", "output_tokens"])
    return totals.select("id", "total_input_tokens", "total_output_tokens")


@query("E03_strict_x", """
SELECT id, i + MAX(x - i) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS x_strict
FROM (SELECT id, session_id, epoch_us(ts) // 60000000 AS x, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i FROM session_turn_metrics)""")
def _(t):
    minutes = t.session_turn_metrics.select("id", "session_id", F.expr("unix_micros(ts) div 60000000").alias("x"))
    return series.strictly_increasing(minutes, "session_id", ["id"], "x").select("id", "x_strict")


@query("E04_first_flag", """
SELECT id, CASE WHEN cache_read_tokens > 1000 AND row_number() OVER (PARTITION BY session_id, cache_read_tokens > 1000 ORDER BY id) = 1 THEN input_tokens ELSE 0 END AS first_offset
FROM session_turn_metrics""")
def _(t):
    marked = series.first_qualifying(t.session_turn_metrics, "session_id", ["id"], F.col("cache_read_tokens") > 1000, "input_tokens", "first_offset")
    return marked.select("id", "first_offset")


@query("E05_minmax", """
SELECT hit_id, round(CASE WHEN fts_score IS NULL THEN 0 WHEN hi = lo THEN 1 ELSE (hi - fts_score) / (hi - lo) END, 6) AS fts01
FROM (SELECT *, MIN(fts_score) OVER (PARTITION BY query_id) AS lo, MAX(fts_score) OVER (PARTITION BY query_id) AS hi FROM locate_hits)""")
def _(t):
    pool = Window.partitionBy("query_id")
    scaled = min_max(F.col("fts_score"), F.min("fts_score").over(pool), F.max("fts_score").over(pool))
    return t.locate_hits.select("hit_id", F.round(scaled, 6).alias("fts01"))


@query("E06_latest_per_kind", f"""
SELECT kind, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY run_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM {RUNS}) WHERE rn = 1""")
def _(t):
    return series.latest_per(t.runs, ["kind"], ["run_at", "l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("E07_topn_per_type", "SELECT kind, hit_id FROM (SELECT kind, hit_id, row_number() OVER (PARTITION BY kind ORDER BY score DESC, hit_id) AS rn FROM locate_hits) WHERE rn <= 50")
def _(t):
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "hit_id")
    return t.locate_hits.select("kind", "hit_id", F.row_number().over(w).alias("rn")).where("rn <= 50").drop("rn")


@query("E08_last_seen", "SELECT l_partkey AS file_id, arg_max(l_orderkey, (o_orderdate, l_orderkey)) AS last_sha FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def _(t):
    commits = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = t.lineitem.select("l_partkey", "l_orderkey").join(commits, "l_orderkey")
    return joined.groupBy(F.col("l_partkey").alias("file_id")).agg(F.max(F.struct("o_orderdate", "l_orderkey"))["l_orderkey"].alias("last_sha"))


@query("E09_carry_forward", f"""
SELECT id, last_value(CASE WHEN action = 'signup' THEN id END IGNORE NULLS) OVER (PARTITION BY actor ORDER BY id ROWS UNBOUNDED PRECEDING) AS header FROM {LOG}""")
def _(t):
    headed = t.log.withColumn("h", F.when(F.col("action") == "signup", F.col("id")))
    return series.carry_forward(headed, "actor", ["id"], "h", "header").select("id", "header")


# --- H: scalar functions ---------------------------------------------------------------------------


@query("H01_concat", "SELECT doc_id, coalesce(title, '') || chr(10) || source AS joined FROM documents")
def _(t):
    return t.documents.select("doc_id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "source").alias("joined"))


@query("H02_trim_split", r"SELECT doc_id, trim(title, '\"''.,:;') AS trimmed, len(regexp_split_to_array(trim(title), '\s+')) AS words FROM documents WHERE title IS NOT NULL".replace('\\"', '"'))
def _(t):
    titled = t.documents.where("title is not null")
    return titled.select("doc_id", F.btrim("title", F.lit("\"'.,:;")).alias("trimmed"), F.size(F.split(F.trim("title"), r"\s+")).cast("long").alias("words"))


@query("H03_prefix_route", r"SELECT doc_id, regexp_extract(lower(text), '^(decision|note|docs|fact)s?[ :]', 1) AS route FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_extract(F.lower("text"), r"^(decision|note|docs|fact)s?[ :]", 1).alias("route"))


@query("H04_path_normalise", r"SELECT id, replace(path, '\', '/') AS path FROM indexed_files")
def _(t):
    return t.indexed_files.select("id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))


@query("H05_lower_contains", "SELECT id, lower(path) AS path, CASE WHEN contains(lower(path), 'cache') THEN 1 ELSE 0 END AS has_cache, CASE WHEN starts_with(path, 'apps/') THEN 1 ELSE 0 END AS is_app FROM indexed_files")
def _(t):
    low = F.lower("path")
    return t.indexed_files.select("id", low.alias("path"), F.contains(low, F.lit("cache")).cast("int").alias("has_cache"), F.startswith("path", F.lit("apps/")).cast("int").alias("is_app"))


@query("H06_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 79) || '…' ELSE text END AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", clip(F.col("text"), 80).alias("short"))


@query("H07_language", r"""
SELECT id, map {'rs': 'rust', 'cs': 'csharp', 'java': 'java', 'ts': 'typescript', 'tsx': 'typescript', 'js': 'javascript', 'jsx': 'javascript', 'mjs': 'javascript',
  'cjs': 'javascript', 'py': 'python', 'go': 'go'}[lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))] AS language FROM indexed_files""")
def _(t):
    return t.indexed_files.select("id", language_of(F.col("path")).alias("language"))


@query("H08_snippet", """
SELECT id, CASE WHEN length(short) < length(embed_text) THEN short || '…' ELSE short END AS snippet
FROM (SELECT id, embed_text, left(array_to_string(string_split(embed_text, chr(10))[1:6], chr(10)), 400) AS short FROM code_chunks)""")
def _(t):
    return t.code_chunks.select("id", snippet(F.col("embed_text")).alias("snippet"))


@query("H09_cell_escape", r"SELECT doc_id, trim(regexp_replace(replace(coalesce(title, '') || ' | ' || source, '|', '\|'), '\s+', ' ', 'g')) AS cell FROM documents")
def _(t):
    return t.documents.select("doc_id", cell(F.concat(F.coalesce("title", F.lit("")), F.lit(" | "), "source")).alias("cell"))


@query("H10_url_slug", r"""
SELECT doc_id, regexp_replace(lower(replace(regexp_replace(regexp_replace('git@host.example:' || path || '.git', '^[a-z+]+://|^[^@/]+@', ''), '\.git/?$|/$', ''), ':', '/')), '[^a-z0-9]+', '-', 'g') AS slug,
  left(sha256(path), 7) AS short FROM documents""")
def _(t):
    url = F.concat(F.lit("git@host.example:"), "path", F.lit(".git"))
    return t.documents.select("doc_id", slug(url).alias("slug"), F.left(F.sha2(F.encode("path", "UTF-8"), 256), F.lit(7)).alias("short"))


@query("H11_embed_text", "SELECT doc_id, sha256(CASE WHEN source = 'session_note' THEN text WHEN text = '' THEN coalesce(title, '') ELSE coalesce(title, '') || chr(10) || text END) AS embedded FROM documents")
def _(t):
    kind = F.when(F.col("source") == "session_note", "note").otherwise("doc")
    text = embed_text(kind, F.coalesce("title", F.lit("")), F.col("text"))
    return t.documents.select("doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("embedded"))


@query("H12_source_derive", "SELECT session_id, project_id, CASE WHEN recall_calls = 0 THEN 'user' ELSE 'user+agent:' || agent END AS source FROM session_metrics")
def _(t):
    source = F.when(F.col("recall_calls") == 0, "user").otherwise(F.concat(F.lit("user+agent:"), "agent"))
    return t.session_metrics.select("session_id", "project_id", source.alias("source"))


@query("H13_julian_diff", f"SELECT id, round((epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at)) / 86400000000.0, 6) AS age FROM {TASKS}")
def _(t):
    return t.tasks.select("id", F.round(days_between(orders_now(), F.col("verified_at")), 6).alias("age"))


@query("H14_trunc_sec", f"SELECT id, epoch_us(date_trunc('second', tm) + INTERVAL 12 HOUR) AS cap FROM {LOG}")
def _(t):
    return t.log.select("id", F.unix_micros(F.date_trunc("second", "at") + F.expr("interval 12 hours")).alias("cap"))


@query("H15_epoch", f"SELECT id, CAST(floor(epoch_us(tm) / 1000000.0) AS BIGINT) AS epoch, strftime(tm, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM {LOG}")
def _(t):
    return t.log.select("id", F.unix_timestamp("at").alias("epoch"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("H16_localtime", f"SELECT id, strftime(tm + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS local FROM {LOG}")
def _(t):
    return t.log.select("id", F.date_format(F.from_utc_timestamp("at", "Etc/GMT-2"), "yyyy-MM-dd HH:mm").alias("local"))


@query("H17_coalesce_greatest", "SELECT hit_id, COALESCE(NULLIF(symbol, ''), kind) AS name, GREATEST(0, COALESCE(end_line, start_line) - start_line) AS span FROM locate_hits")
def _(t):
    span = F.greatest(F.lit(0), F.coalesce("end_line", "start_line") - F.col("start_line"))
    return t.locate_hits.select("hit_id", F.coalesce(F.nullif("symbol", F.lit("")), "kind").alias("name"), span.alias("span"))


@query("H18_half_life", f"""
SELECT id, round(CASE WHEN age <= 0 THEN 1 ELSE exp(-age * ln(2) / 365) END, 6) AS decay FROM (SELECT id, (epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at)) / 86400000000.0 AS age FROM {TASKS})""")
def _(t):
    return t.tasks.select("id", F.round(age_decay(days_between(orders_now(), F.col("verified_at")), 365.0), 6).alias("decay"))


@query("H19_clamp", "SELECT hit_id, LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, score * 2 - 0.5)) AS clamped FROM locate_hits")
def _(t):
    return t.locate_hits.select("hit_id", clamp01(F.col("score") * 2 - 0.5).alias("clamped"))


@query("H20_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t.embeddings.select("vec_id", "embedding").join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cos"))


@query("H22_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query("H23_json_get", "SELECT event_id, COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, COALESCE(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), 0) AS missing FROM events")
def _(t):
    get = lambda path: F.coalesce(F.get_json_object("props", path).try_cast("long"), F.lit(0))
    return t.events.select("event_id", get("$.k").alias("k"), get("$.missing").alias("missing"))


@query("H24_json_valid", "SELECT file_id, line_no, CASE WHEN json_valid(trim(raw_line)) AND starts_with(trim(raw_line), '{') THEN 1 ELSE 0 END AS valid FROM transcript_lines")
def _(t):
    good = F.try_parse_json(F.trim("raw_line")).isNotNull() & F.startswith(F.trim("raw_line"), F.lit("{"))
    return t.transcript_lines.select("file_id", "line_no", good.cast("int").alias("valid"))


@query("H26_thousands", "SELECT project_id, format('{:,}', SUM(input_tokens)::BIGINT) AS shown FROM session_metrics GROUP BY project_id")
def _(t):
    return t.session_metrics.groupBy("project_id").agg(F.format_number(F.sum("input_tokens"), 0).alias("shown"))


@query("H28_ordinal", "SELECT session_id, TRY_CAST(regexp_extract(session_id, '^[0-9a-f]+-([0-9]+)-', 1) AS BIGINT) AS ordinal FROM session_metrics")
def _(t):
    return t.session_metrics.select("session_id", F.regexp_extract("session_id", r"^[0-9a-f]+-([0-9]+)-", 1).try_cast("long").alias("ordinal"))


@query("H27_token_shape", r"""
SELECT doc_id, len(ts) AS n, len(list_distinct(ts)) AS distinct_n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents)""")
def _(t):
    ts = tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(ts).cast("long").alias("n"), F.size(F.array_distinct(ts)).cast("long").alias("distinct_n"))


QUERIES, SQL = family.QUERIES, family.SQL
