"""Projections, filters (B), joins (C), aggregates (D), order and limits (F), set operations (G)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpie.functions.predicates import DEFAULT_DENY, blank_label, has_all, is_accepted, is_denied, is_stale, path_class, within_days
from kelpie.functions.scalars import tokens
from kelpie.operators import joins, lifecycle, series
from kelpie.plans.base import EVENTS_AS_OF, ORDERS_AS_OF, Family, events_now, orders_now

family = Family()
query = family.query
DENY = [*DEFAULT_DENY, "tests/*", "*_test.{py,go}", "[a-c]*_min*.go", "store/{cache,**/window}*"]
TASKS = f"""(SELECT o_orderkey AS id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'blocked' END AS status,
  o_orderpriority AS source, o_orderdate AS verified_at, o_totalprice AS value,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1 END AS superseded_by FROM orders)"""
LOG = """(SELECT event_id AS id, user_id AS actor, event_type AS action, ts AS tm, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props FROM events)"""
RUNS = """(SELECT l_orderkey, l_linenumber, l_returnflag AS kind, l_linestatus AS cmdline, l_discount < 0.05 AS success, l_shipdate AS run_at FROM lineitem)"""
STALE_SQL = f"(verified_at IS NULL OR epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at) > 90 * 86400000000)"


# --- B: projections and filters --------------------------------------------------------------------


@query("B01_list_order", f"SELECT id, status, value FROM {TASKS} ORDER BY value DESC, id")
def _(t):
    return t.tasks.select("id", "status", "value").orderBy(F.desc("value"), "id")


@query("B02_status_filter", f"SELECT id, owner FROM {TASKS} WHERE status = 'open' ORDER BY id DESC LIMIT 50")
def _(t):
    return t.tasks.where("status = 'open'").select("id", "owner").orderBy(F.desc("id")).limit(50)


@query("B03_stale_flag", f"SELECT id, CASE WHEN {STALE_SQL} THEN 1 ELSE 0 END AS stale FROM {TASKS}")
def _(t):
    return t.tasks.select("id", is_stale(F.col("verified_at"), orders_now(), 90).cast("int").alias("stale"))


@query("B04_recent_window", f"SELECT id, action FROM {LOG} WHERE tm >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY")
def _(t):
    return t.log.where(within_days(F.col("at"), events_now(), 7)).select("id", "action")


@query("B05_accepted_source", """
SELECT doc_id, CASE WHEN mapped = 'user' OR starts_with(mapped, 'user+agent:') THEN 1 ELSE 0 END AS accepted FROM (
  SELECT doc_id, CASE source WHEN 'decision' THEN 'user' WHEN 'fact' THEN 'user+agent:' || source ELSE source END AS mapped FROM documents)""")
def _(t):
    source = F.when(F.col("source") == "decision", "user").when(F.col("source") == "fact", "user+agent:fact").otherwise(F.col("source"))
    return t.documents.select("doc_id", is_accepted(source).cast("int").alias("accepted"))


@query("B06_allowlist", "SELECT doc_id, source FROM documents WHERE source IN ('fact', 'decision', 'task')")
def _(t):
    wanted = list(dict.fromkeys(["fact", "decision", "fact", "task"]))  # repeats don't change the order
    return t.documents.where(F.col("source").isin(wanted)).select("doc_id", "source")


@query("B07_null_aware", """
SELECT CASE WHEN lang IS NULL THEN 1 ELSE 0 END AS no_lang, CASE WHEN lang IS DISTINCT FROM 'en' THEN 1 ELSE 0 END AS not_en, COUNT(*) AS n
FROM documents GROUP BY 1, 2""")
def _(t):
    flags = (F.col("lang").isNull().cast("int").alias("no_lang"), (~F.col("lang").eqNullSafe("en")).cast("int").alias("not_en"))
    return t.documents.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("B08_deny_glob", r"""
SELECT id, CASE WHEN len(list_filter(suffixes, lambda s: s <> '' AND (
  list_contains(['.env', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', '.aws/credentials'], s)
  OR starts_with(s, '.env.') OR starts_with(s, 'id_rsa.') OR starts_with(s, 'id_dsa.') OR starts_with(s, 'id_ecdsa.') OR starts_with(s, 'id_ed25519.')
  OR ends_with(s, '.pem') OR ends_with(s, '.key') OR ends_with(s, '.p12') OR ends_with(s, '.pfx')
  OR starts_with(s, 'secrets/') OR starts_with(s, '.gnupg/') OR starts_with(s, '.gcloud/credentials') OR starts_with(s, 'tests/') OR ends_with(s, '_test.py') OR ends_with(s, '_test.go')
  OR (left(s, 1) BETWEEN 'a' AND 'c' AND ends_with(s, '.go') AND contains(substr(s, 2), '_min'))
  OR starts_with(s, 'store/cache') OR (starts_with(s, 'store/') AND (starts_with(substr(s, 7), 'window') OR contains(substr(s, 7), '/window')))))) > 0 THEN 1 ELSE 0 END AS denied
FROM (SELECT id, list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '/')) AS suffixes
  FROM (SELECT id, string_split(regexp_replace(path, '^(\./)+', ''), '/') AS parts FROM indexed_files))""")
def _(t):
    return t.indexed_files.select("id", is_denied(F.col("path"), DENY).cast("int").alias("denied"))


@query("B09_path_class", r"""
SELECT id, CASE WHEN starts_with(path, 'tests/') OR starts_with(path, 'benches/') OR starts_with(path, 'examples/') THEN 'test'
  WHEN contains(string_split(path, '/')[-1], '.min.') THEN 'minified' WHEN contains(path, '/') OR contains(path, '\') OR contains(path, '.') THEN 'path' ELSE 'text' END AS class
FROM (SELECT id, path FROM indexed_files UNION ALL SELECT -id, regexp_replace(path, '^[^/]*/[^/]*/', '') FROM indexed_files UNION ALL SELECT -1000000 - doc_id, title FROM documents WHERE title IS NOT NULL)""")
def _(t):
    below = t.indexed_files.select((-F.col("id")).alias("id"), F.regexp_replace("path", "^[^/]*/[^/]*/", "").alias("path"))  # as seen from a project's own folder
    titles = t.documents.where("title is not null").select((-1_000_000 - F.col("doc_id")).alias("id"), F.col("title").alias("path"))
    return t.indexed_files.select("id", "path").unionByName(below).unionByName(titles).select("id", path_class(F.col("path")).alias("class"))


@query("B10_and_terms", """
SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM documents)
WHERE list_contains(ts, 'credit') AND list_contains(ts, 'score')""")
def _(t):
    ts = tokens(F.col("text"))
    return t.documents.where(F.array_contains(ts, "credit") & F.array_contains(ts, "score")).select("doc_id")


@query("B11_score_floor", "SELECT hit_id, kind FROM locate_hits WHERE rerank_score >= CASE WHEN kind = 'module' THEN 0.5 ELSE 0.0 END")
def _(t):
    floor = F.when(F.col("kind") == "module", 0.5).otherwise(0.0)
    return t.locate_hits.where(F.col("rerank_score") >= floor).select("hit_id", "kind")


@query("B13_drop_unhydrated", "SELECT h.hit_id FROM locate_hits h JOIN code_chunks c ON c.id = h.chunk_id JOIN indexed_files f ON f.id = c.file_id WHERE f.language IS NOT NULL")
def _(t):
    files = t.indexed_files.where("language is not null").select(F.col("id").alias("file_id"))
    chunks = t.code_chunks.select(F.col("id").alias("chunk_id"), "file_id").join(files, "file_id")
    return t.locate_hits.join(chunks, "chunk_id").select("hit_id")


@query("B14_corrupt_split", "SELECT CASE WHEN len(embedding) = 64 AND vec_id % 11 <> 0 THEN 'usable' ELSE 'corrupt' END AS state, COUNT(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    vector = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    state = F.when(F.size(vector) == 64, "usable").otherwise("corrupt")
    return t.embeddings.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("B15_blank_label", "SELECT COALESCE(NULLIF(lang, ''), '(blank)') AS lang, COUNT(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(blank_label(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("B16_all_substrings", "SELECT doc_id FROM documents WHERE contains(lower(text), 'credit') AND contains(lower(text), 'the yield')")
def _(t):
    return t.documents.where(has_all(F.col("text"), ["Credit", "the yield"])).select("doc_id")


@query("B17_optional_filters", f"SELECT id FROM {LOG} WHERE action = 'error' AND tm >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY ORDER BY tm DESC, id LIMIT 100")
def _(t):
    rows = t.log
    for wanted in (F.col("action") == "error", within_days(F.col("at"), events_now(), 14)):  # those that are given
        rows = rows.where(wanted)
    return rows.orderBy(F.desc("at"), "id").limit(100).select("id")


@query("B20_doc_safety", "SELECT doc_id FROM documents WHERE source <> 'doc_chunk'")
def _(t):
    reranked = False
    return (t.documents if reranked else t.documents.where("source <> 'doc_chunk'")).select("doc_id")


# --- C: joins --------------------------------------------------------------------------------------


@query("C01_history_join", """
SELECT o_orderkey AS sha, l_linenumber AS line, p_name AS path FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE p_partkey = 42 ORDER BY o_orderdate DESC, o_orderkey, l_linenumber LIMIT 20""")
def _(t):
    file = t.part.where("p_partkey = 42")
    joined = t.lineitem.join(file, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    top = joined.orderBy(F.desc("o_orderdate"), "o_orderkey", "l_linenumber").limit(20)
    return top.select(F.col("o_orderkey").alias("sha"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("path"))


@query("C02_cast_join", "SELECT h.hit_id, c.symbol FROM locate_hits h JOIN code_chunks c ON CAST(CAST(h.chunk_id AS VARCHAR) AS BIGINT) = c.id WHERE h.hit_rank = 1")
def _(t):
    hits = t.locate_hits.where("hit_rank = 1").select("hit_id", F.col("chunk_id").cast("string").alias("source_id"))
    return hits.join(t.code_chunks, F.col("source_id").cast("long") == F.col("id")).select("hit_id", "symbol")


@query("C03_chunk_doc_join", "SELECT f.language, COUNT(*) AS chunks FROM code_chunks c JOIN indexed_files f ON f.id = c.file_id GROUP BY 1")
def _(t):
    files = t.indexed_files.select(F.col("id").alias("file_id"), "language")
    return t.code_chunks.select("file_id").join(files, "file_id").groupBy("language").agg(F.count(F.lit(1)).alias("chunks"))


@query("C04_chunk_file_join", "SELECT c.id AS chunk_id, f.path, c.start_line, c.end_line FROM code_chunks c JOIN indexed_files f ON f.id = c.file_id WHERE c.kind = 'module'")
def _(t):
    chunks = t.code_chunks.where("kind = 'module'").select(F.col("id").alias("chunk_id"), "file_id", "start_line", "end_line")
    return chunks.join(t.indexed_files.select(F.col("id").alias("file_id"), "path"), "file_id").select("chunk_id", "path", "start_line", "end_line")


@query("C05_anti_null", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def _(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("C06_anti_exists", "SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.source <> 'task')")
def _(t):
    sources = t.documents.where("source <> 'task'").select(F.col("doc_id").alias("vec_id"))
    return lifecycle.orphans(t.embeddings.select("vec_id"), sources, ["vec_id"])


@query("C07_anti_notin", "SELECT id FROM session_turn_metrics WHERE session_id NOT IN (SELECT session_id FROM session_metrics WHERE session_id IS NOT NULL)")
def _(t):
    return lifecycle.orphans(t.session_turn_metrics.select("id", "session_id"), t.session_metrics, ["session_id"]).select("id")


@query("C08_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    blocked = t.orders.where("o_orderstatus = 'P'")
    return t.customer.join(blocked, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


_ATTRIBUTED = f"""
SELECT event_id, session FROM (
  SELECT r.id AS event_id, s.id AS session, row_number() OVER (PARTITION BY r.id ORDER BY date_trunc('second', s.tm) DESC, s.id DESC) AS rn
  FROM {LOG} r JOIN {LOG} s ON r.action = 'view' AND s.action = 'signup' AND r.actor = s.actor
    AND date_trunc('second', r.tm) BETWEEN date_trunc('second', s.tm) AND date_trunc('second', s.tm) + INTERVAL 12 HOUR) WHERE rn = 1"""


def _attributed(t):
    views = t.log.where("action = 'view'").select(F.col("id").alias("event_id"), "actor", "at")
    sessions = t.log.where("action = 'signup'").select(F.col("id").alias("session"), "actor", F.col("at").alias("started"))
    end = F.date_trunc("second", F.col("started")) + F.expr("interval 12 hours")
    return joins.attribute_to_intervals(views, sessions, ["actor"], "at", "started", end, "event_id", "session")


@query("C09_interval_asof", _ATTRIBUTED)
def _(t):
    return _attributed(t)


@query("C10_full_outer_merge", """
SELECT COALESCE(d.doc_id, e.vec_id) AS id, CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END AS in_text, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS in_vectors
FROM (SELECT doc_id FROM documents WHERE source = 'decision') d FULL OUTER JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(t):
    text = t.documents.where("source = 'decision'").select(F.col("doc_id").alias("id"), F.lit(1).alias("in_text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(1).alias("in_vectors"))
    joined = text.join(vectors, "id", "full_outer")
    return joined.select("id", F.coalesce("in_text", F.lit(0)).alias("in_text"), F.coalesce("in_vectors", F.lit(0)).alias("in_vectors"))


@query("C11_hydrate", """
SELECT w.source_type, w.source_id, label FROM (SELECT 'doc' AS source_type, vec_id AS source_id FROM embeddings UNION ALL SELECT DISTINCT 'code', chunk_id FROM locate_hits) w
JOIN (SELECT 'doc' AS source_type, doc_id AS source_id, title AS label FROM documents UNION ALL SELECT 'code', id, symbol FROM code_chunks) s USING (source_type, source_id)""")
def _(t):
    sources = t.documents.select(F.lit("doc").alias("source_type"), F.col("doc_id").alias("source_id"), F.col("title").alias("label")).unionByName(
        t.code_chunks.select(F.lit("code").alias("source_type"), F.col("id").alias("source_id"), F.col("symbol").alias("label"))
    )
    wanted = t.embeddings.select(F.lit("doc").alias("source_type"), F.col("vec_id").alias("source_id")).unionByName(
        t.locate_hits.select(F.lit("code").alias("source_type"), F.col("chunk_id").alias("source_id")).distinct()
    )
    return wanted.join(sources, ["source_type", "source_id"])


@query("C12_tagged_union_join", """
SELECT kind, id, label FROM (SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'chunk', id FROM code_chunks) s JOIN embeddings e ON e.vec_id = s.id""")
def _(t):
    tagged = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")).unionByName(
        t.code_chunks.select(F.lit("chunk").alias("kind"), "id")
    )
    return tagged.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id").select("kind", "id", "label")


@query("C13_correlated", """
SELECT f.id AS file_id, (SELECT COUNT(*) FROM code_chunks c WHERE c.file_id = f.id) AS chunks,
  COALESCE((SELECT SUM(c.end_line - c.start_line + 1) FROM code_chunks c WHERE c.file_id = f.id), 0)::BIGINT AS lines FROM indexed_files f""")
def _(t):
    counted = t.code_chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.expr("end_line - start_line + 1")).alias("lines"))
    joined = t.indexed_files.select(F.col("id").alias("file_id")).join(counted, "file_id", "left")
    return joined.select("file_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("C14_self_link", f"SELECT a.id, COALESCE(b.source, CAST(a.superseded_by AS VARCHAR)) AS replacement FROM {TASKS} a LEFT JOIN {TASKS} b ON b.id = a.superseded_by WHERE a.superseded_by IS NOT NULL")
def _(t):
    linked = t.tasks.where("superseded_by is not null").select("id", "superseded_by")
    targets = t.tasks.select(F.col("id").alias("superseded_by"), "source")
    replacement = F.coalesce("source", F.col("superseded_by").cast("string"))
    return linked.join(targets, "superseded_by", "left").select("id", replacement.alias("replacement"))


@query("C15_hash_drift", """
SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN content_hash = sha256(text) THEN 'current' ELSE 'drifted' END AS status FROM documents""")
def _(t):
    stored = t.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), "content_hash")
    return joins.hash_status(t.documents.select(F.col("doc_id").alias("id"), "text"), stored, "id", "text", "content_hash")


@query("C16_nested_loop", """
SELECT query_id, rank, id, cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos, id) AS rank FROM (
  SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cos
  FROM embeddings e, (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 5""")
def _(t):
    from kelpie.operators.retrieval import nearest

    # the farthest vectors, which recall drops
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest(vectors, asked, 64, 5, least=None, score=lambda cos: -np.round(cos, 6))
    return found.select("query_id", "rank", "id", F.round("cos", 6).alias("cos"))


_TURNS_SQL = """(SELECT project_id AS grp, id AS turn, epoch_us(ts) AS x FROM session_turn_metrics WHERE ts IS NOT NULL)"""


@query("C17_forward_asof", f"""
WITH t AS {_TURNS_SQL}, m AS (SELECT grp, turn AS mark, x - 1800000000 AS x FROM t),
p AS (SELECT grp, turn, x, row_number() OVER (PARTITION BY grp ORDER BY x, turn) AS rk FROM t)
SELECT m.mark, COALESCE(n.rk, l.rk) AS rk FROM m
ASOF LEFT JOIN (SELECT grp, x, MIN(rk) AS rk FROM p GROUP BY 1, 2) n ON m.grp = n.grp AND m.x <= n.x
JOIN (SELECT grp, MAX(rk) AS rk FROM p GROUP BY 1) l ON l.grp = m.grp""")
def _(t):
    turns = t.session_turn_metrics.where("ts is not null").select(F.col("project_id").alias("grp"), F.col("id").alias("turn"), F.unix_micros("ts").alias("x"))
    ranked = series.so_far(turns, "grp", [F.col("x"), F.col("turn")], {"rk": ("sum", F.lit(1).cast("long"))})
    marks = turns.select("grp", F.col("turn").alias("mark"), (F.col("x") - 1_800_000_000).alias("mx"))
    return joins.next_at_or_after(ranked, marks, "grp", "x", "mx", "mark", "rk")


@query("C18_change_classes", """
SELECT COALESCE(n.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.mtime = b.mtime THEN 'unchanged'
  WHEN n.content_hash = b.content_hash THEN 'touched' ELSE 'changed' END AS change
FROM (SELECT path, content_hash, mtime FROM indexed_files WHERE id % 13 <> 0) n
FULL OUTER JOIN (SELECT path, CASE WHEN id % 5 = 0 THEN 'x' ELSE content_hash END AS content_hash, CASE WHEN id % 3 = 0 THEN mtime - 1 ELSE mtime END AS mtime
  FROM indexed_files WHERE id % 11 <> 0) b ON b.path = n.path""")
def _(t):
    now = t.indexed_files.where("id % 13 <> 0").select("path", "content_hash", "mtime")
    before = t.indexed_files.where("id % 11 <> 0").select(
        "path",
        F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("id") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"),
    )
    return joins.change_classes(now, before, "path", "content_hash", "mtime")


@query("C19_lookup_fallback", "SELECT h.hit_id, COALESCE(c.symbol, '#' || h.chunk_id) AS title FROM locate_hits h LEFT JOIN code_chunks c ON c.id = h.chunk_id AND c.kind = 'function'")
def _(t):
    names = t.code_chunks.where("kind = 'function'").select(F.col("id").alias("chunk_id"), F.col("symbol").alias("name"))
    title = F.coalesce("name", F.concat(F.lit("#"), F.col("chunk_id")))
    return t.locate_hits.select("hit_id", "chunk_id").join(names, "chunk_id", "left").select("hit_id", title.alias("title"))


@query("C20_id_or_key", "SELECT id, path FROM indexed_files WHERE id = 17 OR path = '17' ORDER BY CASE WHEN id = 17 THEN 0 ELSE 1 END, id LIMIT 1")
def _(t):
    return joins.by_id_or_key(t.indexed_files.select("id", "path"), "17", "id", "path")


# --- D: aggregates ---------------------------------------------------------------------------------


@query("D01_counts", """
SELECT 'documents' AS name, COUNT(*) AS n FROM documents UNION ALL SELECT 'events', COUNT(*) FROM events UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'code_chunks', COUNT(*) FROM code_chunks""")
def _(t):
    counts = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "events", "orders", "code_chunks")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("D02_filtered_counts", f"SELECT COUNT(*) FILTER (WHERE status = 'done') AS done, COUNT(*) FILTER (WHERE {STALE_SQL}) AS stale, COUNT(*) FILTER (WHERE superseded_by IS NOT NULL) AS superseded FROM {TASKS}")
def _(t):
    return t.tasks.agg(
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(is_stale(F.col("verified_at"), orders_now(), 90)).alias("stale"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"),
    )


@query("D03_topn", f"SELECT actor, COUNT(*) AS n FROM {LOG} GROUP BY actor ORDER BY n DESC, actor LIMIT 10")
def _(t):
    return t.log.groupBy("actor").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "actor").limit(10)


@query("D04_status_counts", "SELECT status, COUNT(*) AS n FROM prepared_docs GROUP BY status")
def _(t):
    return t.prepared_docs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("D05_blank_group", "SELECT COALESCE(NULLIF(language, ''), '(blank)') AS label, COUNT(*) AS n FROM indexed_files GROUP BY 1 ORDER BY n DESC, label")
def _(t):
    grouped = t.indexed_files.groupBy(blank_label(F.col("language")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("n"), "label")


@query("D06_union_group", "SELECT source, COUNT(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT status FROM prepared_docs UNION ALL SELECT kind FROM code_chunks) GROUP BY 1")
def _(t):
    rows = t.documents.select("source").unionByName(t.prepared_docs.select(F.col("status").alias("source"))).unionByName(t.code_chunks.select(F.col("kind").alias("source")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("D07_review_rate", f"""
SELECT actor, COUNT(*) AS created, COUNT(*) FILTER (WHERE action = 'purchase') AS reviewed,
  round(COUNT(*) FILTER (WHERE action = 'purchase') / NULLIF(COUNT(*) FILTER (WHERE action IN ('purchase', 'error')), 0), 6) AS rate FROM {LOG} GROUP BY actor""")
def _(t):
    reviewed = F.count_if(F.col("action") == "purchase")
    rate = F.try_divide(reviewed, F.nullif(F.count_if(F.col("action").isin("purchase", "error")), F.lit(0)))
    return t.log.groupBy("actor").agg(F.count(F.lit(1)).alias("created"), reviewed.alias("reviewed"), F.round(rate, 6).alias("rate"))


@query("D08_cond_sum", "SELECT agent, SUM(CASE WHEN recall_calls > 0 THEN input_tokens ELSE 0 END)::BIGINT AS with_recall, SUM(input_tokens)::BIGINT AS total FROM session_metrics GROUP BY agent")
def _(t):
    with_recall = F.sum(F.when(F.col("recall_calls") > 0, F.col("input_tokens")).otherwise(0))
    return t.session_metrics.groupBy("agent").agg(with_recall.alias("with_recall"), F.sum("input_tokens").alias("total"))


_RECALLS = f"(SELECT actor, CASE WHEN k % 3 <> 0 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS bundle, k * 100 AS ledger, id, tm FROM {LOG} WHERE action = 'view')"


def _recalls(t):
    bundle = F.when(F.col("k") % 3 != 0, F.floor("value")).otherwise(0)
    return t.log.where("action = 'view'").select("actor", bundle.alias("bundle"), (F.col("k") * 100).alias("ledger"), "id", "at")


@query("D09_two_level_having", f"SELECT COALESCE(SUM(least_ledger), 0)::BIGINT AS offset_tokens FROM (SELECT actor, MIN(ledger) AS least_ledger FROM {_RECALLS} GROUP BY actor HAVING MAX(bundle) > 0)")
def _(t):
    sessions = _recalls(t).groupBy("actor").agg(F.min("ledger").alias("least_ledger"), F.max("bundle").alias("most")).where("most > 0")
    return sessions.agg(F.coalesce(F.sum("least_ledger"), F.lit(0)).alias("offset_tokens"))


@query("D10_group_count", f"SELECT COUNT(*) AS sessions FROM (SELECT actor FROM {_RECALLS} GROUP BY actor HAVING MAX(bundle) > 90)")
def _(t):
    return _recalls(t).groupBy("actor").agg(F.max("bundle").alias("most")).where("most > 90").agg(F.count(F.lit(1)).alias("sessions"))


@query("D11_multi_sum", "SELECT project_id, " + ", ".join(f"COALESCE(SUM({c}), 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")) + " FROM session_turn_metrics GROUP BY project_id")
def _(t):
    counters = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return t.session_turn_metrics.groupBy("project_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


@query("D12_mean_ratio", "SELECT agent, round(AVG(cache_read_tokens / NULLIF(cache_read_tokens + input_tokens, 0)) * 100, 6) AS mean_hit FROM session_metrics GROUP BY agent")
def _(t):
    ratio = F.try_divide(F.col("cache_read_tokens"), F.nullif(F.col("cache_read_tokens") + F.col("input_tokens"), F.lit(0)))
    return t.session_metrics.groupBy("agent").agg(F.round(F.avg(ratio) * 100, 6).alias("mean_hit"))


@query("D13_ratio_of_sums", "SELECT agent, round(SUM(cache_creation_tokens) * 100.0 / NULLIF(SUM(cache_read_tokens), 0), 6) AS churn FROM session_metrics GROUP BY agent")
def _(t):
    churn = F.try_divide(F.sum("cache_creation_tokens") * F.lit(100.0).cast("double"), F.nullif(F.sum("cache_read_tokens"), F.lit(0)))
    return t.session_metrics.groupBy("agent").agg(F.round(churn, 6).alias("churn"))


@query("D14_median_int", "SELECT agent, CAST(trunc(median(baseline_input_tokens)) AS BIGINT) AS baseline FROM session_metrics WHERE recall_calls = 0 AND baseline_input_tokens IS NOT NULL GROUP BY agent")
def _(t):
    rows = t.session_metrics.where("recall_calls = 0 and baseline_input_tokens is not null")
    return rows.groupBy("agent").agg(series.median_integer(F.col("baseline_input_tokens")).alias("baseline"))


@query("D15_median", "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@query("D16_min_max", "SELECT event_type, MIN(event_id) AS first_id, MAX(event_id) AS last_id, epoch_us(MAX(ts)) AS last_at FROM events GROUP BY event_type")
def _(t):
    return t.log.groupBy(F.col("action").alias("event_type")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.unix_micros(F.max("at")).alias("last_at"))


@query("D17_confidence", f"SELECT kind, cmdline, round(COUNT(*) FILTER (WHERE success) / COUNT(*), 6) AS confidence FROM {RUNS} GROUP BY 1, 2")
def _(t):
    return t.runs.groupBy("kind", "cmdline").agg(F.round(F.try_divide(F.count_if("success"), F.count(F.lit(1))), 6).alias("confidence"))


@query("D18_first_value", "SELECT session_id, arg_min(input_tokens + cache_read_tokens + cache_creation_tokens, id) AS baseline FROM session_turn_metrics GROUP BY session_id")
def _(t):
    first = F.min_by(F.expr("input_tokens + cache_read_tokens + cache_creation_tokens"), "id")
    return t.session_turn_metrics.groupBy("session_id").agg(first.alias("baseline"))


@query("D19_ts_bounds", "SELECT session_id, epoch_us(MIN(ts)) AS first_at, epoch_us(MAX(ts)) AS last_at FROM session_turn_metrics GROUP BY session_id")
def _(t):
    return t.session_turn_metrics.groupBy("session_id").agg(F.unix_micros(F.min("ts")).alias("first_at"), F.unix_micros(F.max("ts")).alias("last_at"))


_FRAME = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N;' ELSE 'V' || octet_length(encode({c}::VARCHAR)) || ':' || {c} || ';' END" for c in ("doc_id", "title", "text", "lang", "source"))


@query("D20_digest", f"""
WITH b AS (SELECT MIN(doc_id)::DOUBLE AS low, MAX(doc_id)::DOUBLE AS high FROM documents),
h AS (SELECT doc_id, LEAST(CAST(floor((doc_id::DOUBLE - low) * (4096 / (high - low))) AS INTEGER), 4095) AS slice, sha256({_FRAME}) AS h FROM documents, b),
s AS (SELECT slice, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS d, COUNT(*) AS n FROM h GROUP BY slice)
SELECT 'documents' AS table_name, SUM(n)::BIGINT AS row_count, sha256('documents|' || string_agg(slice || '=' || d, '|' ORDER BY slice)) AS digest FROM s""")
def _(t):
    from kelpie.operators.digest import table_digest

    return table_digest(t.documents, "documents", ["doc_id"], ["doc_id", "title", "text", "lang", "source"])


@query("D21_change_counts", f"""
SELECT action, COUNT(*) FILTER (WHERE k < 50) AS inserts, COUNT(*) FILTER (WHERE k >= 50) AS others, COUNT(DISTINCT actor) AS touched, arg_max(props, id) AS latest_reason
FROM {LOG} WHERE id > 500 GROUP BY action""")
def _(t):
    return t.log.where("id > 500").groupBy("action").agg(
        F.count_if(F.col("k") < 50).alias("inserts"),
        F.count_if(F.col("k") >= 50).alias("others"),
        F.count_distinct("actor").alias("touched"),
        F.max_by("props", "id").alias("latest_reason"),
    )


@query("D22_distinct", "SELECT COUNT(DISTINCT l_partkey) AS files, COUNT(DISTINCT l_orderkey) AS commits FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("files"), F.count_distinct("l_orderkey").alias("commits"))


_TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("D23_corpus_stats", f"SELECT COUNT(*) AS n_docs, SUM(len(ts))::BIGINT AS n_tokens, round(AVG(len(ts)), 6) AS mean_length FROM (SELECT {_TOKENS_SQL} AS ts FROM documents)")
def _(t):
    sized = t.documents.select(F.size(tokens(F.col("text"))).alias("d"))
    return sized.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("d").alias("n_tokens"), F.round(F.avg("d"), 6).alias("mean_length"))


@query("D24_coverage", """
SELECT d.source, COUNT(*) AS total, COUNT(e.vec_id) AS embedded, COUNT(*) - COUNT(e.vec_id) AS missing, round(COUNT(e.vec_id) / COUNT(*), 6) AS ratio
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source""")
def _(t):
    joined = t.documents.select("doc_id", "source").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e")), "doc_id", "left")
    total, embedded = F.count(F.lit(1)), F.count("e")
    return joined.groupBy("source").agg(
        total.alias("total"), embedded.alias("embedded"), (total - embedded).alias("missing"), F.round(F.try_divide(embedded, total), 6).alias("ratio")
    )


@query("D25_recall_at_k", """
SELECT kind, COUNT(*) AS queries, round(AVG(CASE WHEN best = 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(AVG(CASE WHEN best <= 3 THEN 1 ELSE 0 END), 6) AS recall_3
FROM (SELECT query_id, kind, MIN(hit_rank) AS best FROM locate_hits GROUP BY 1, 2) GROUP BY kind""")
def _(t):
    best = t.locate_hits.groupBy("query_id", "kind").agg(F.min("hit_rank").alias("best"))
    return best.groupBy("kind").agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg((F.col("best") == 1).cast("int")), 6).alias("recall_1"),
        F.round(F.avg((F.col("best") <= 3).cast("int")), 6).alias("recall_3"),
    )


@query("D26_token_sum", "SELECT project_id, SUM(CAST(ceil((length(coalesce(title, '')) + 1 + length(text)) / 4.0) AS BIGINT))::BIGINT AS tokens FROM documents GROUP BY project_id")
def _(t):
    from kelpie.functions.budget import approximate_tokens

    bundle = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("text"))
    return t.documents.groupBy("project_id").agg(F.sum(approximate_tokens(bundle)).alias("tokens"))


@query("D27_keep_newest", """
SELECT project_id, COUNT(*) AS freed, SUM(size)::BIGINT AS freed_bytes FROM (
  SELECT project_id, size, row_number() OVER (PARTITION BY project_id ORDER BY mtime DESC, id DESC) AS rn FROM indexed_files) WHERE rn > 20 GROUP BY project_id""")
def _(t):
    return lifecycle.freed_by_keeping(t.indexed_files, "project_id", [F.desc("mtime"), F.desc("id")], 20, "size")


@query("D28_vector_mean", """
SELECT pos - 1 AS dim, round(AVG(x), 6) AS mean, round(MAX(abs(x)), 6) AS scale
FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos""")
def _(t):
    cells = t.embeddings.select(F.posexplode("embedding").alias("dim", "x")).select(F.col("dim").cast("long"), F.col("x").cast("double").alias("x"))
    return cells.groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max(F.abs("x")), 6).alias("scale"))


# --- F: order and limits ---------------------------------------------------------------------------


@query("F01_four_key_topk", "SELECT hit_id, kind, query_id FROM locate_hits ORDER BY score DESC, kind, query_id, hit_id LIMIT 50")
def _(t):
    return t.locate_hits.orderBy(F.desc("score"), "kind", "query_id", "hit_id").limit(50).select("hit_id", "kind", "query_id")


@query("F02_locate_order", "SELECT hit_id FROM locate_hits ORDER BY score DESC, chunk_id, hit_id LIMIT 30")
def _(t):
    return t.locate_hits.orderBy(F.desc("score"), "chunk_id", "hit_id").limit(30).select("hit_id")


@query("F04_case_sort", f"SELECT id, status FROM {TASKS} ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'blocked' THEN 1 WHEN 'done' THEN 2 ELSE 3 END, id LIMIT 200")
def _(t):
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "blocked", 1).when(F.col("status") == "done", 2).otherwise(3)
    return t.tasks.orderBy(rank, "id").limit(200).select("id", "status")


@query("F05_nulls_last", "SELECT id, symbol FROM code_chunks ORDER BY symbol DESC NULLS LAST, id LIMIT 100")
def _(t):
    return t.code_chunks.orderBy(F.desc_nulls_last("symbol"), "id").limit(100).select("id", "symbol")


@query("F06_null_keys", "SELECT id FROM code_chunks ORDER BY (symbol IS NULL) DESC, COALESCE(symbol, ''), id LIMIT 100")
def _(t):
    return t.code_chunks.orderBy(F.col("symbol").isNull().desc(), F.coalesce("symbol", F.lit("")), "id").limit(100).select("id")


@query("F07_pool_then_top", "SELECT hit_id FROM (SELECT * FROM locate_hits ORDER BY score DESC, hit_id LIMIT 50) ORDER BY vector_score DESC, hit_id LIMIT 10")
def _(t):
    pool = t.locate_hits.orderBy(F.desc("score"), "hit_id").limit(50)
    return pool.orderBy(F.desc("vector_score"), "hit_id").limit(10).select("hit_id")


@query("F08_head_tail", "SELECT hit_id FROM locate_hits ORDER BY (rerank_score IS NULL), rerank_score DESC, score DESC, hit_id LIMIT 200")
def _(t):
    order = [F.col("rerank_score").isNull(), F.desc_nulls_last("rerank_score"), F.desc("score"), F.col("hit_id")]
    return t.locate_hits.orderBy(*order).limit(200).select("hit_id")


@query("F09_count_then_top", f"SELECT id, (SELECT COUNT(*) FROM {TASKS} WHERE status = 'blocked') AS total FROM {TASKS} WHERE status = 'blocked' ORDER BY verified_at, id LIMIT 25")
def _(t):
    blocked = t.tasks.where("status = 'blocked'")
    total = blocked.groupBy("status").agg(F.count(F.lit(1)).alias("total"))
    return blocked.orderBy("verified_at", "id").limit(25).join(total, "status").select("id", "total")


# --- G: set operations -----------------------------------------------------------------------------


@query("G01_union_all", "SELECT source AS label FROM documents UNION ALL SELECT kind FROM code_chunks")
def _(t):
    return t.documents.select(F.col("source").alias("label")).unionByName(t.code_chunks.select(F.col("kind").alias("label")))


@query("G02_scope_union", "SELECT scope, COUNT(*) AS n FROM (SELECT 'repo' AS scope FROM documents WHERE project_id <> 1 UNION ALL SELECT 'global' FROM documents WHERE project_id = 1) GROUP BY scope")
def _(t):
    repo = t.documents.where("project_id <> 1").select(F.lit("repo").alias("scope"))
    return repo.unionByName(t.documents.where("project_id = 1").select(F.lit("global").alias("scope"))).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("G03_category_concat", f"""
SELECT 'fact' AS category, id FROM {TASKS} WHERE {STALE_SQL} AND superseded_by IS NULL UNION ALL SELECT 'document', prep_id FROM prepared_docs WHERE chunk_count IS NULL
UNION ALL SELECT 'session', project_id FROM session_metrics WHERE ended_at IS NULL""")
def _(t):
    facts = t.tasks.where(is_stale(F.col("verified_at"), orders_now(), 90) & F.col("superseded_by").isNull()).select(F.lit("fact").alias("category"), "id")
    docs = t.prepared_docs.where("chunk_count is null").select(F.lit("document").alias("category"), F.col("prep_id").alias("id"))
    open_sessions = t.session_metrics.where("ended_at is null").select(F.lit("session").alias("category"), F.col("project_id").alias("id"))
    return facts.unionByName(docs).unionByName(open_sessions)


@query("G04_key_union", "SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings")
def _(t):
    return t.documents.select(F.col("doc_id").alias("id")).unionByName(t.embeddings.select(F.col("vec_id").alias("id"))).distinct()


@query("G05_difference", "SELECT id FROM indexed_files WHERE id NOT IN (SELECT file_id FROM code_chunks WHERE kind = 'function')")
def _(t):
    return t.indexed_files.select("id").join(t.code_chunks.where("kind = 'function'").select(F.col("file_id").alias("id")), "id", "left_anti")


@query("G06_sorted_distinct", "SELECT DISTINCT lower(path) AS path FROM indexed_files ORDER BY 1")
def _(t):
    return t.indexed_files.select(F.lower("path").alias("path")).distinct().orderBy("path")


QUERIES, SQL = family.QUERIES, family.SQL
