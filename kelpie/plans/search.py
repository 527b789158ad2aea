"""Retrieval queries (I)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kelpie.functions.predicates import days_between, is_stale, is_test_path
from kelpie.functions.scalars import age_decay, cosine, tokens
from kelpie.operators import joins, rerank, retrieval
from kelpie.operators.retrieval import Weights
from kelpie.plans.base import ORDERS_AS_OF, Family, orders_now
from kelpie.plans.relational import STALE_SQL, TASKS

family = Family()
query = family.query

_TS = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_WORD_TS = _TS.replace("lambda x: x", "lambda y: y").format(c="""trim(w, '"'',.:;')""")


def _bm25_sql(source: str, key: str, title: str, text: str) -> str:
    """BM25 over two columns for the titles of every fiftieth document, by counts in lists instead of postings."""
    return rf"""
d AS (SELECT {key} AS id, list_concat({_TS.format(c=title)}, {_TS.format(c=text)}) AS ts FROM {source}),
c AS (SELECT COUNT(*) AS n, AVG(len(ts)) AS avgdl FROM d),
q AS (SELECT doc_id AS query_id, list_filter(list_transform(regexp_split_to_array(trim(title), '\s+'), lambda w: {_WORD_TS}), lambda p: len(p) > 0) AS ps FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
p AS (SELECT query_id, unnest(ps) AS words, unnest(range(1, len(ps) + 1)) AS i, len(ps) AS k FROM q),
tf AS (SELECT query_id, k, i, d.id, len(d.ts) AS dl, CASE WHEN len(words) = 1 THEN len(list_filter(d.ts, lambda x: x = words[1]))
  ELSE len(list_filter(range(1, len(d.ts) + 1), lambda j: d.ts[j:j + len(words) - 1] = words)) END AS f FROM d JOIN p ON list_contains(d.ts, words[1])),
hit AS (SELECT * FROM tf WHERE f > 0),
df AS (SELECT query_id, i, COUNT(*) AS df FROM hit GROUP BY 1, 2),
s AS (SELECT query_id, id, -SUM(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM hit JOIN df USING (query_id, i), c GROUP BY query_id, id, k HAVING COUNT(*) = k)"""


def _asked(t):
    """The titles of every fiftieth document."""
    return t.documents.where("doc_id % 50 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _docs(t, *besides):
    return retrieval.tokenised(t.documents, "doc_id", ["title", "text"], besides)


@query("I01_tokens", f"SELECT token, COUNT(*) AS n FROM (SELECT unnest({_TS.format(c='text')}) AS token FROM documents) GROUP BY token")
def _(t):
    return t.documents.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("I02_phrase_and", r"""
SELECT doc_id AS id FROM (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS s FROM documents)
WHERE contains(s, ' credit score ') AND contains(s, ' yield ')""")
def _(t):
    docs = retrieval.tokenised(t.documents, "doc_id", ["text"])
    asked = t.spark.createDataFrame([(1, "credit-score yield")], "query_id long, query string")
    phrases = retrieval.query_phrases(asked).withColumn("phrase", F.array_join("words", " "))
    return retrieval.holding_all(retrieval.phrase_hits(docs, phrases), phrases).select("id")


@query("I03_bm25", f"WITH {_bm25_sql('documents', 'doc_id', 'title', 'text')} SELECT query_id, rank, id, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), id) AS rank FROM s) WHERE rank <= 10")
def _(t):
    texts, asked_as = retrieval.once_per_text(_asked(t))
    scored = retrieval.bm25(_docs(t), texts).withColumn("bm25", F.round("bm25", 6))
    top = retrieval.top_per_query(scored, [F.col("bm25"), F.col("id")], 10)
    return retrieval.for_every_query(top, asked_as).select("query_id", "rank", "id", "bm25")


@query("I04_topn_per_type", f"""
WITH {_bm25_sql('documents', 'doc_id', 'title', 'text')} SELECT query_id, source, id FROM (
  SELECT s.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY round(bm25, 6), id) AS rank FROM s JOIN documents ON doc_id = id) WHERE rank <= 5""")
def _(t):
    texts, asked_as = retrieval.once_per_text(_asked(t))
    scored = retrieval.bm25(_docs(t, "source"), texts).withColumn("bm25", F.round("bm25", 6))
    top = retrieval.top_per_query(scored, [F.col("bm25"), F.col("id")], 5, within=["source"])
    return retrieval.for_every_query(top, asked_as).select("query_id", "source", "id")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _every_fiftieth(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("I05_vector_topk", f"""
SELECT query_id, rank, id, cos FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS cos,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 6) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {_COS} >= 0) WHERE rank <= 20""")
def _(t):
    return retrieval.nearest(_vectors(t), _every_fiftieth(t), 64, 20).select("query_id", "rank", "id", F.col("score").alias("cos"))


@query("I05_cells_recall", "SELECT COUNT(*) AS queries, 1 AS recall_is_enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    # approximate search against the exact one: at least nine of ten of the ten nearest are found
    exact = retrieval.nearest(_vectors(t), _every_fiftieth(t), 64, 10).select("query_id", "id")
    near = retrieval.nearest_in_cells(_vectors(t), _every_fiftieth(t), retrieval.fit_cells(_vectors(t), 64), 10).select("query_id", "id", F.lit(1).alias("found"))
    held = exact.join(near, ["query_id", "id"], "left")
    return held.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count(F.lit(1))).cast("int").alias("recall_is_enough"))


@query("B12_nonneg_cosine", f"""
SELECT query_id, id FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 6), e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {_COS} >= 0) WHERE rank <= 20""")
def _(t):
    # the vectors that are just not dropped
    return retrieval.nearest(_vectors(t), _every_fiftieth(t), 64, 20, score=lambda cos: -np.round(cos, 6)).select("query_id", "id")


_HYBRID = f"""
{_bm25_sql('documents', 'doc_id', 'title', 'text')},
lex AS (SELECT query_id, id, bm25 FROM (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25, id) AS rank FROM (SELECT query_id, id, round(bm25, 6) AS bm25 FROM s)) WHERE rank <= 50 AND query_id IN (SELECT vec_id FROM embeddings)),
vec AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS cos FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {_COS} >= 0),
cand AS (SELECT COALESCE(lex.query_id, vec.query_id) AS query_id, COALESCE(lex.id, vec.id) AS id, bm25, cos FROM lex FULL OUTER JOIN vec ON lex.query_id = vec.query_id AND lex.id = vec.id),
norm AS (SELECT *, CASE WHEN bm25 IS NULL THEN 0.0 WHEN hi = lo THEN 1.0 ELSE (hi - bm25) / (hi - lo) END AS fts01
  FROM (SELECT *, MIN(bm25) OVER (PARTITION BY query_id) AS lo, MAX(bm25) OVER (PARTITION BY query_id) AS hi FROM cand))"""


def _candidates(t, weights, most):
    """Scored candidates of every fiftieth vector and of the title of the document of its id: the 50 best texts,
    and of the other vectors the `most` that score best."""
    asked = _every_fiftieth(t)
    texts, asked_as = retrieval.once_per_text(_asked(t).join(asked.select("query_id"), "query_id", "left_semi"))
    scored = retrieval.bm25(_docs(t), texts).withColumn("bm25", F.round("bm25", 6))
    top = retrieval.for_every_query(retrieval.top_per_query(scored, [F.col("bm25"), F.col("id")], 50), asked_as)
    lexical = retrieval.normalised(top.select("query_id", "id", "bm25"), ["query_id"])
    flagged = _flagged(t, _vectors(t))
    both = lexical.join(flagged.select("id", "vector"), "id", "left").join(asked.withColumnRenamed("vector", "_asked"), "query_id")
    with_cos = both.select("query_id", "id", "fts01", F.when(F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("_asked"))).alias("cos"))
    with_text = retrieval.fused(_flagged(t, with_cos), weights).select("query_id", "id", F.round("score", 6).alias("score"))
    decay = age_decay(F.col("age_days"), weights.half_life_days).alias("decay")
    penalty = (F.col("stale").cast("double") * weights.stale + F.col("superseded").cast("double") * weights.superseded).alias("penalty")
    of_vector = weights.vector
    by_vector = lambda cos, decay, penalty: np.round(of_vector * np.minimum(cos, 1.0) * decay - penalty, 6)
    others = retrieval.nearest(flagged.select("id", "vector", decay, penalty), asked, 64, most + 50, extra=("decay", "penalty"), score=by_vector)
    alone = others.select("query_id", "id", "score").join(with_text, ["query_id", "id"], "left_anti")
    return with_text.unionByName(alone)


def _flagged(t, candidates):
    """Candidates with the age, staleness and replacement of the task of the same id."""
    facts = t.tasks.select(
        "id", days_between(orders_now(), F.col("verified_at")).alias("age_days"), is_stale(F.col("verified_at"), orders_now(), 90).alias("stale"),
        F.col("superseded_by").isNotNull().alias("superseded"),
    )
    flagged = candidates.join(facts, "id", "left")
    return flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("stale", "superseded")})


_FUSED = f"""
fused AS (SELECT query_id, id, round((0.5 * fts01 + 0.5 * LEAST(1, GREATEST(0, COALESCE(cos, 0)))) * CASE WHEN age IS NULL OR age <= 0 THEN 1 ELSE exp(-age * ln(2) / 365) END
  - CASE WHEN stale THEN 0.3 ELSE 0 END - CASE WHEN superseded THEN 0.4 ELSE 0 END, 6) AS score
  FROM norm LEFT JOIN (SELECT id, (epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at)) / 86400000000.0 AS age, {STALE_SQL} AS stale, superseded_by IS NOT NULL AS superseded FROM {TASKS}) USING (id))"""


@query("I06_hybrid", f"WITH {_HYBRID}, {_FUSED} SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10")
def _(t):
    scored = _candidates(t, Weights(half_life_days=365.0), 10)
    return retrieval.top_per_query(scored, [F.desc("score"), F.col("id")], 10).select("query_id", "rank", "id", "score")


@query("I07_code_fusion", f"""
SELECT query_id, rank, hit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, hit_id) AS rank FROM (
  SELECT query_id, hit_id, chunk_id, round((0.4 * fts01 + 0.6 * LEAST(1, GREATEST(0, vector_score))) * CASE WHEN string_split(own, '/')[1] IN ('tests', 'benches', 'examples') AND contains(own, '/') THEN 0.9 ELSE 1 END, 6) AS score FROM (
    SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - fts_score) / (hi - lo) END AS fts01 FROM (
      SELECT *, MIN(fts_score) OVER (PARTITION BY query_id) AS lo, MAX(fts_score) OVER (PARTITION BY query_id) AS hi FROM (SELECT *, regexp_replace(path, '^[^/]*/[^/]*/', '') AS own FROM locate_hits))))) WHERE rank <= 10""")
def _(t):
    pool = t.locate_hits.select("query_id", "hit_id", "chunk_id", "path", F.col("fts_score").alias("bm25"), F.col("vector_score").alias("cos"))
    scored = retrieval.fused_code(retrieval.normalised(pool, ["query_id"]), Weights(text=0.4, vector=0.6), is_test_path(F.regexp_replace("path", "^[^/]*/[^/]*/", "")))  # the path within its project
    top = retrieval.top_per_query(scored.withColumn("score", F.round("score", 6)), [F.desc("score"), F.col("chunk_id"), F.col("hit_id")], 10)
    return top.select("query_id", "rank", "hit_id", "score")


@query("I08_age_decay", f"""
SELECT id, round(CASE WHEN status = 'open' OR age <= 0 THEN 1 ELSE exp(-age * ln(2) / 180) END, 6) AS decay
FROM (SELECT id, status, (epoch_us(TIMESTAMP '{ORDERS_AS_OF}') - epoch_us(verified_at)) / 86400000000.0 AS age FROM {TASKS})""")
def _(t):
    age = F.when(F.col("status") != "open", days_between(orders_now(), F.col("verified_at")))  # open tasks don't age
    return t.tasks.select("id", F.round(age_decay(age, 180.0), 6).alias("decay"))


@query("I09_rerank")
def _(t):
    asked, asked_as = retrieval.once_per_text(_asked(t))
    top = retrieval.cut(retrieval.top_per_query(retrieval.bm25(_docs(t), asked), [F.col("bm25"), F.col("id")], 20))
    documents = t.documents.select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"))
    texts = top.join(retrieval.of_ids(documents, top), "id").join(asked, "query_id")
    scored = rerank.reranked(texts, rerank.LexicalOverlap(), floor=0.0)
    best = retrieval.for_every_query(scored, asked_as).orderBy("query_id", F.desc_nulls_last("rerank"), "id")
    return best.select("query_id", "id", F.round("rerank", 6).alias("rerank"))


@query("I10_cross_store", f"""
WITH {_HYBRID}, {_FUSED}, scoped AS (SELECT CASE WHEN id % 4 = 0 THEN 'global' ELSE 'repo' END AS scope, fused.* FROM fused)
SELECT query_id, rank, scope, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scope, id) AS rank FROM scoped) WHERE rank <= 10""")
def _(t):
    scored = _candidates(t, Weights(half_life_days=365.0), 10)  # ids that are no multiple of 4 are the repository's
    scoped = scored.withColumn("scope", F.when(F.col("id") % 4 == 0, "global").otherwise("repo"))
    return retrieval.top_per_query(scoped, [F.desc("score"), F.col("scope"), F.col("id")], 10).select("query_id", "rank", "scope", "id", "score")


@query("I11_warnings", f"""
SELECT 'stale_embeddings' AS warning, COUNT(*) AS n FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 10 <> 0 AND content_hash <> sha256(text)
UNION ALL SELECT 'stale_facts_demoted', COUNT(*) FROM {TASKS} WHERE {STALE_SQL}""")
def _(t):
    stored = t.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), "content_hash")
    embedded = t.documents.select(F.col("doc_id").alias("id"), "text").join(t.embeddings.select(F.col("vec_id").alias("id")), "id", "left_semi")
    drifted = joins.hash_status(embedded, stored, "id", "text", "content_hash").where("status = 'drifted'")
    facts = t.tasks.where(is_stale(F.col("verified_at"), orders_now(), 90))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("warning"), "n")
    return count(drifted, "stale_embeddings").unionByName(count(facts, "stale_facts_demoted"))


@query("I12_available_docs", """
SELECT project_id, CASE WHEN COUNT(*) FILTER (WHERE source = 'doc_chunk') = 0 THEN 'none' WHEN COUNT(*) FILTER (WHERE source = 'doc_chunk') < 5 THEN 'few' ELSE 'available' END AS cue
FROM documents GROUP BY project_id""")
def _(t):
    n = F.count_if(F.col("source") == "doc_chunk")
    return t.documents.groupBy("project_id").agg(F.when(n == 0, "none").when(n < 5, "few").otherwise("available").alias("cue"))


@query("I14_routed", r"""
SELECT doc_id, CASE WHEN starts_with(title, 'file:') THEN 'exact:file-history' WHEN p.path IS NOT NULL THEN 'exact:file-history'
  WHEN regexp_matches(lower(title), '^decisions?[ :]') THEN 'fts:decision' ELSE 'fts:decision-fallback' END AS matcher
FROM (SELECT doc_id, COALESCE(CASE WHEN doc_id % 17 = 0 THEN f.path ELSE title END, '') AS title FROM documents LEFT JOIN indexed_files f ON f.id = doc_id) d
LEFT JOIN (SELECT DISTINCT path FROM indexed_files) p ON p.path = d.title""")
def _(t):
    files = t.indexed_files.select(F.col("id").alias("doc_id"), F.col("path").alias("file_path"))
    asked = t.documents.select("doc_id", "title").join(files, "doc_id", "left")
    asked = asked.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 17 == 0, F.col("file_path")).otherwise(F.col("title")), F.lit("")).alias("title"))
    paths = t.indexed_files.select(F.col("path").alias("title"), F.lit(True).alias("known")).distinct()
    matcher = (
        F.when(F.col("title").startswith("file:") | F.col("known").isNotNull(), "exact:file-history")
        .when(F.lower("title").rlike(r"^decisions?[ :]"), "fts:decision")
        .otherwise("fts:decision-fallback")
    )
    return asked.join(paths, "title", "left").select("doc_id", matcher.alias("matcher"))


@query("I15_derived_chunks", "SELECT 'decision' AS source_type, doc_id AS source_id, sha256(COALESCE(title, '') || chr(10) || text) AS digest FROM documents WHERE source = 'decision'")
def _(t):
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "text")
    chosen = t.documents.where("source = 'decision'")
    return chosen.select(F.lit("decision").alias("source_type"), F.col("doc_id").alias("source_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))


@query("I16_same_key_conflict", "SELECT title, COUNT(*) AS n, COUNT(DISTINCT content_hash) AS versions FROM documents WHERE title IS NOT NULL GROUP BY title HAVING COUNT(DISTINCT content_hash) > 1")
def _(t):
    keyed = t.documents.where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("versions"))
    return keyed.where("versions > 1")


@query("I18_embed_skip", "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, content_hash FROM documents WHERE doc_id % 3 <> 0) s ON s.doc_id = d.doc_id AND s.content_hash = d.content_hash WHERE s.doc_id IS NULL")
def _(t):
    stored = t.documents.where("doc_id % 3 <> 0").select("doc_id", "content_hash")
    return t.documents.select("doc_id", "content_hash").join(stored, ["doc_id", "content_hash"], "left_anti").select("doc_id")


@query("I19_embed_dedup", "SELECT content_hash, COUNT(*) AS uses FROM code_chunks GROUP BY content_hash")
def _(t):
    return t.code_chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("uses"))


@query("I20_rebuild_hash_check", "SELECT doc_id, CASE WHEN content_hash = sha256(text) THEN 'write' ELSE 'retry' END AS action FROM documents JOIN embeddings ON vec_id = doc_id")
def _(t):
    embedded = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    current = F.col("content_hash") == F.sha2(F.encode("text", "UTF-8"), 256)
    return embedded.select("doc_id", F.when(current, "write").otherwise("retry").alias("action"))


@query("I21_pca")
def _(t):
    from kelpie.operators.projection import pca_2d

    return pca_2d(_vectors(t)).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("F03_bm25_then_date", f"""
WITH {_bm25_sql('documents', 'doc_id', 'title', 'text')} SELECT query_id, rank, id FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), ingested_at DESC NULLS LAST, id) AS rank FROM s JOIN documents ON doc_id = id) WHERE rank <= 20""")
def _(t):
    texts, asked_as = retrieval.once_per_text(_asked(t))
    dated = retrieval.bm25(_docs(t), texts).join(t.documents.select(F.col("doc_id").alias("id"), "ingested_at"), "id")
    top = retrieval.top_per_query(dated, [F.round("bm25", 6), F.desc_nulls_last("ingested_at"), F.col("id")], 20)
    return retrieval.for_every_query(top, asked_as).select("query_id", "rank", "id")


@query("N01_eval", f"""
WITH {_bm25_sql('documents', 'doc_id', 'title', 'text')}, r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), id) AS rank FROM s),
g AS (SELECT doc_id AS query_id, title AS needle, doc_id % 100 = 50 AS none FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL),
h AS (SELECT g.query_id, none, r.id, rank, contains(lower(text), lower(needle)) AS good FROM g LEFT JOIN r ON r.query_id = g.query_id AND rank <= 3 AND NOT none LEFT JOIN documents ON doc_id = id),
e AS (SELECT query_id, ANY_VALUE(none) AS none, COALESCE(bool_or(good AND rank = 1), FALSE) AS at_1, COALESCE(bool_or(good), FALSE) AS at_3, COUNT(id) AS hits FROM h GROUP BY query_id)
SELECT COUNT(*) FILTER (WHERE NOT none) AS matches, COUNT(*) FILTER (WHERE NOT none AND at_1) AS at_1, COUNT(*) FILTER (WHERE NOT none AND at_3) AS at_3,
  COUNT(*) FILTER (WHERE none) AS empties, COUNT(*) FILTER (WHERE none AND hits > 0) AS safety_failures FROM e""")
def _(t):
    from kelpie.operators.evaluation import evaluate

    # every hundredth golden query is one that nothing answers
    none = F.col("query_id") % 100 == 50
    asked = _asked(t).select("query_id", F.when(none, F.concat("query", F.lit(" zzqxv"))).otherwise(F.col("query")).alias("query"))
    golden = _asked(t).select("query_id", F.when(none, "empty").otherwise("match").alias("kind"), F.array("query").alias("needles"))
    texts, asked_as = retrieval.once_per_text(asked)
    scored = retrieval.bm25(_docs(t), texts).withColumn("bm25", F.round("bm25", 6))
    top = retrieval.for_every_query(retrieval.top_per_query(scored, [F.col("bm25"), F.col("id")], 3), asked_as)
    ranked = top.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    return evaluate(ranked, golden, "text", (1, 3))


QUERIES, SQL = family.QUERIES, family.SQL
