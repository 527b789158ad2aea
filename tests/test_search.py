import math
import os
import random
import re

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import retrieval
from kelpie.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TEXTS = ["the red fox", "the red-hot fox saw the fox", "a red hot day", "the the the", "", None, "fox red", "red hot red hot red"]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, query):
    """BM25 of one query by counting."""
    docs = [words(t) for t in texts]
    phrases = [p for p in (words(w.strip("\"',.:;")) for w in query.split()) if p]
    count = lambda d, p: sum(d[i : i + len(p)] == p for i in range(len(d)))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        if phrases and all(count(d, p) for p in phrases):
            total = 0.0
            for p in phrases:
                df = sum(count(e, p) > 0 for e in docs)
                idf = math.log((n - df + 0.5) / (df + 0.5))
                total -= (idf if idf > 0 else 1e-6) * count(d, p) * 2.2 / (count(d, p) + 1.2 * (0.25 + 0.75 * len(d) / mean))
            out[i] = round(total, 9)
    return out


def test_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = [(i, t) for i, t in enumerate(TEXTS)] + [(20, "fox missing"), (21, "red-hot"), (22, "the fox the"), (23, "..."), (24, "red-hot-red")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    tokenised = retrieval.tokenised(docs, "doc_id", ["text"])
    got = {}
    for r in retrieval.bm25(tokenised, queries).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = round(r["bm25"], 9)
    assert got == {i: b for i, q in asked if q and (b := brute(TEXTS, q))} and len(got) > 5
    assert retrieval.bm25(tokenised, queries.limit(0)).count() == 0 and retrieval.bm25(tokenised.limit(0), queries).count() == 0


def test_plan_of_bm25_pairs_nothing(spark):
    docs = retrieval.tokenised(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "doc_id", ["text"])
    queries = spark.createDataFrame([(1, "red fox")], "query_id long, query string")
    phrases = retrieval.query_phrases(queries)
    for df in (retrieval.phrase_hits(docs, phrases), retrieval.bm25(docs, queries)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest(spark):
    random.seed(4)
    vectors = [(i, [random.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], float(i % 3)) for i in range(700)] + [(900, None, 0.0), (901, [1.0], 0.0), (902, [0.0] * 4, 0.0)]
    vectors += [(1000 + i, vectors[0][1], 0.0) for i in range(300)]  # a third are copies
    df = spark.createDataFrame(vectors, "id long, vector array<float>, extra double").repartition(5)
    asked = [(i, v) for i, v, _ in vectors[:20]] + [(500, None), (501, [0.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n > 1e-12 else 0.0

    for least, factor in ((0.0, 1.0), (None, -1.0)):
        want = []
        for q, a in asked:
            if a is not None:
                scored = [(round(factor * cos(a, v), 6), i) for i, v, _ in vectors if v is not None and len(v) == 4 and (least is None or cos(a, v) >= least)]
                want += [(q, i) for _, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:7]]
        got = retrieval.nearest(df, queries, 4, 7, least=least, score=lambda c: np.round(factor * c, 6))  # noqa: B023
        assert rows(got, "query_id", "id") == sorted(want, key=repr)
    shifted = retrieval.nearest(df, queries, 4, 3, extra=("extra",), score=lambda c, e: c + e)
    assert all(r["score"] >= r["cos"] for r in shifted.collect())
    assert retrieval.nearest(df.limit(0), queries, 4, 3).count() == 0 and retrieval.nearest(df, queries.limit(0), 4, 3).count() == 0
    blocks, retrieval.QUERY_BLOCK = retrieval.QUERY_BLOCK, 6
    try:
        assert rows(retrieval.nearest(df, queries, 4, 7), "query_id", "id", "rank") == rows(retrieval.nearest(df.coalesce(1), queries, 4, 7), "query_id", "id", "rank")
    finally:
        retrieval.QUERY_BLOCK = blocks


def test_cells_index_every_row(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((800, 8)) + 3 * rng.standard_normal((8, 8))[np.arange(800) % 8])]
    df = spark.createDataFrame(data, "id long, vector array<float>")
    cells = retrieval.fit_cells(df, 8, cells=8, sample=100)
    assert cells.number(df).count() == 800
    queries = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = set(rows(retrieval.nearest(df, queries, 8, 10), "query_id", "id"))
    near = set(rows(retrieval.nearest_in_cells(df, queries, cells, 10, probes=4), "query_id", "id"))
    assert len(exact & near) >= 0.9 * len(exact)
    everything = set(rows(retrieval.nearest_in_cells(df, queries, cells, 10, probes=8), "query_id", "id"))
    assert len(exact & everything) >= 0.99 * len(exact)


NEVER_BROADCAST = [
    "F03_bm25_then_date",
    "I03_bm25",
    "I06_hybrid",
    "I10_cross_store",
    "I02_phrase_and",
    "I04_topn_per_type",
    "I09_rerank",
    "N01_eval",
]


@pytest.mark.parametrize("name", NEVER_BROADCAST)
def test_exploded_documents_are_never_broadcast(spark, monkeypatch, name):
    plans, cut = [], retrieval.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(retrieval, "cut", lambda df: cut(plan(df)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")  # more than Spark takes the documents to be
    try:
        plan(catalogue.QUERIES[name](spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    seen = 0
    for text in plans:
        depth = 10**6  # of the broadcast above a line, if there is one
        for line in text.splitlines():
            at = re.search(r"\w", line).start() if re.search(r"\w", line) else 0
            depth = at if "BroadcastExchange" in line and at <= depth else depth if at > depth else 10**6
            if re.search(r"explode\(concat\(terms", line):
                seen += 1
                assert at <= depth, text
    assert seen


def test_queries_of_one_text_are_scored_once(spark):
    queries = spark.createDataFrame([(7, "red fox"), (3, "red fox"), (5, "day"), (9, "nothing holds")], "query_id long, query string")
    docs = retrieval.tokenised(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "doc_id", ["text"])
    texts, asked_as = retrieval.once_per_text(queries)
    assert rows(texts, "query_id", "query") == [(3, "red fox"), (5, "day"), (9, "nothing holds")]
    once = retrieval.bm25(docs, texts)
    assert rows(retrieval.for_every_query(once, asked_as), "query_id", "id") == rows(retrieval.bm25(docs, queries), "query_id", "id") == sorted([(3, 0), (3, 1), (3, 6), (7, 0), (7, 1), (7, 6), (5, 2)], key=repr)


def test_blocks_give_the_same(spark, monkeypatch):
    docs = retrieval.tokenised(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "doc_id", ["text"])
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id long, query string")
    whole = rows(retrieval.bm25(docs, queries).selectExpr("query_id", "id", "round(bm25, 9) as bm25"))
    monkeypatch.setattr(retrieval, "PHRASE_BLOCK", 2)
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 2)
    assert rows(retrieval.bm25(docs, queries).selectExpr("query_id", "id", "round(bm25, 9) as bm25")) == whole and len(whole) > 5


def test_documents_are_moved_as_a_row_each(spark, monkeypatch):
    plans, cut = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    docs = retrieval.tokenised(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "doc_id", ["text"])
    phrases = retrieval.query_phrases(spark.createDataFrame([(1, "red red-hot the fox missing")], "query_id long, query string"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # so that documents lie in several batches
    try:
        got = {(r["phrase"], r["id"]): r["f"] for r in retrieval.phrase_hits(docs, phrases).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    count = lambda d, p: sum(d[i : i + len(p)] == p for i in range(len(d)))
    want = {(p, i): n for p in ("red", "red hot", "the", "fox", "missing") for i, t in enumerate(TEXTS) if (n := count(words(t), p.split()))}
    assert got == want | {("", i): 1 for i in range(len(TEXTS))}
    moved = [line for text in plans if "explode(concat(terms" in text for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "phrase" in line or "word" in line]


MOVED_AS_ROWS = [
    "I02_phrase_and",
    "I10_cross_store",
    "I04_topn_per_type",
    "I09_rerank",
]


@pytest.mark.parametrize("name", MOVED_AS_ROWS)
def test_queries_move_documents_as_a_row_each(spark, monkeypatch, name):
    plans, cut = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    catalogue.QUERIES[name](spark, DATA)
    moved = [line for text in plans if "explode(concat(terms" in text for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "phrase" in line or "word" in line]


def test_scores_keep_what_is_beside(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 2}" if i else None) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "the")], "query_id long, query string")
    found = retrieval.bm25(retrieval.tokenised(docs, "doc_id", ["text"], ("source",)), queries)
    assert rows(found, "query_id", "id", "source") == sorted([(1, 0, None), (1, 1, "s1"), (1, 6, "s0"), (2, 0, None), (2, 1, "s1"), (2, 3, "s1")], key=repr)
    assert retrieval.bm25(retrieval.tokenised(docs.limit(0), "doc_id", ["text"], ("source",)), queries).columns == ["query_id", "id", "source", "bm25"]


def test_texts_to_rerank_are_never_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32m")  # more than Spark takes the texts to be
    try:
        lines = catalogue.QUERIES["I09_rerank"](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = [re.search(r"\w", line).start() if re.search(r"\w", line) else 0 for line in lines]
    seen = 0
    for i, line in enumerate(lines):
        if "Scan parquet" in line and re.search(r"\[.*text#", line):
            seen, depth = seen + 1, at[i]
            for j in range(i, -1, -1):  # the nodes above it, each less indented than those below
                if at[j] < depth:
                    depth = at[j]
                    assert "BroadcastExchange" not in lines[j], "\n".join(lines)
    assert seen
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    chosen = spark.createDataFrame([(3,), (5,), (3,), (77,)], "id long")
    assert rows(retrieval.of_ids(docs, chosen)) == [(3, TEXTS[3]), (5, None)] and retrieval.of_ids(docs, chosen.limit(0)).count() == 0
