import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.functions import predicates as P
from kelpie.functions import scalars as S
from kelpie.operators import chunkers, digest, evaluation, joins, lifecycle, projection, rerank, retrieval, series

T0 = dt.datetime(2026, 1, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- functions


def test_staleness_edges(spark):
    df = spark.createDataFrame([(1, T0 - dt.timedelta(days=90)), (2, T0 - dt.timedelta(days=90, seconds=1)), (3, None)], "id int, at timestamp")
    assert rows(df.where(P.is_stale(F.col("at"), F.lit(T0), 90)), "id") == [(2,), (3,)]


def test_deny(spark):
    assert rows(spark.createDataFrame([("config/server.pem",), ("./a.pem",), ("a.pem.txt",), (None,), ("",)], "p string").select(P.is_denied(F.col("p"), ["*.pem"]).alias("d"))) == [(False,)] * 3 + [(True,)] * 2
    with pytest.raises(ValueError):
        P.deny_regex(["a[b"])
    for bad in ("a{b", "a}b", "{a,{b}", "[]"):
        with pytest.raises(ValueError):
            P.deny_regex([bad])
    cases = [("a/b.pem", "*.{pem,key}", True), ("a/b.pe", "*.{pem,key}", False), ("a,b", "a,b", True), ("x/ab3", "a{b{1,3},c}", True), ("ab2", "a{b{1,3},c}", False), ("././.env", ".env", True),
             ("a/secrets/x/y", "secrets/**", True), ("secrets", "secrets/**", False), ("a]b", "a[]x]b", True), ("a^b", "a[!x]b", True), ("axb", "a[!x]b", False), ("a.pem\n", "*.pem", False), ("a*", "a\\*", True)]
    for path, glob, want in cases:
        assert value(spark, P.is_denied(F.lit(path), [glob])) is want, (path, glob)
    assert all(value(spark, P.is_denied(F.lit(p), P.DEFAULT_DENY)) for p in ("id_rsa", "k/id_rsa.pub", "a/x.p12", "home/.aws/credentials", "secrets/a/b", ".env.local"))
    tests = {"tests/foo.rs": True, "benches/b.rs": True, "examples/ex.rs": True, "src/foo.rs": False, "src/tests/foo.rs": False, "": False}
    assert {p: value(spark, P.is_test_path(F.lit(p))) for p in tests} == tests
    assert value(spark, P.is_denied(F.lit("x"), [])) is False


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, S.cosine(v(1, 0), v(2, 0))) == 1.0
    assert value(spark, S.cosine(v(0, 0), v(2, 0))) == 0.0 and value(spark, S.cosine(v(1), v(2, 0))) == 0.0
    assert value(spark, S.cosine(F.lit(None).cast("array<double>"), v(1))) == 0.0


def test_decay_and_clip(spark):
    assert value(spark, S.age_decay(F.lit(None).cast("double"), 10.0)) == 1.0 and value(spark, S.age_decay(F.lit(5.0), 0.0)) == 1.0
    assert abs(value(spark, S.age_decay(F.lit(10.0), 10.0)) - 0.5) < 1e-12
    assert value(spark, S.clip(F.lit("äöü"), 2)) == "ä…" and value(spark, S.snippet(F.lit("a\nb"))) == "a\nb"


# --- retrieval


def bm25(spark, texts, query):
    docs = retrieval.tokenised(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", ["text"])
    return {r["id"]: r["bm25"] for r in retrieval.bm25(docs, spark.createDataFrame([(1, query)], "query_id long, query string")).collect()}


def test_phrases_and_floor(spark):
    assert set(bm25(spark, ["foo bar", "bar foo", "foo-bar baz", None, ""], "foo-bar")) == {0, 2}
    assert all(abs(v) < 1e-5 for v in bm25(spark, ["a x", "a y", "a z", "b"], "a").values())
    assert bm25(spark, ["a b"], " .;' ") == {} and bm25(spark, ["a b", "a"], "a b") .keys() == {0}


def test_normalisation(spark):
    df = spark.createDataFrame([(1, 1, -2.0, None), (1, 2, -1.0, 0.5), (1, 3, None, 0.4), (2, 1, -1.0, None)], "query_id int, id int, bm25 double, cos double")
    assert rows(retrieval.normalised(df, ["query_id"]), "query_id", "id", "fts01") == [(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0), (2, 1, 1.0)]


def test_fusion_penalties(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, True, True), (1.0, -0.5, None, False, False)], "fts01 double, cos double, age_days double, stale boolean, superseded boolean")
    assert [round(r["score"], 6) for r in retrieval.fused(df, retrieval.Weights()).collect()] == [-0.2, 0.5]


def test_corrupt_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "id long, vector array<float>")
    assert rows(retrieval.corrupt(df, 2), "id") == [(2,), (3,)]
    asked = spark.createDataFrame([(7, [-1.0, 0.0])], "query_id long, vector array<float>")
    assert retrieval.nearest(df, asked, 2, 5).count() == 0
    assert rows(retrieval.nearest(df, asked, 2, 5, least=None), "query_id", "id", "cos") == [(7, 1, -1.0)]


def test_rerank_lone_candidate(spark):
    pool = spark.createDataFrame([(1, "a b", 1, "a", "b"), (2, "a b", 1, "a b", None), (2, "a b", 2, "c", "d")], "query_id long, query string, id long, title string, body string")
    assert rows(rerank.reranked(pool, rerank.LexicalOverlap(), floor=0.5)) == [(1, 1, None), (2, 1, 1.0)]


def test_recall_at(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "Foo BAR"), (2, 1, None)], "query_id long, rank int, text string")
    golden = spark.createDataFrame([(1, ["foo", "bar"]), (2, ["foo"])], "query_id long, needles array<string>")
    assert rows(evaluation.recall_at(ranked, golden, "text", (1, 3))) == [(1, 0, 1), (2, 0, 0)]


def test_pca(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(5)], "id long, vector array<float>")
    assert [round(r["x"], 6) for r in projection.pca_2d(df).orderBy("id").collect()] in ([-1, -0.5, 0, 0.5, 1], [1, 0.5, 0, -0.5, -1])


# --- joins


def test_intervals(spark):
    s = lambda **k: T0 + dt.timedelta(**k)
    sessions = spark.createDataFrame([(1, "u", s(), s(hours=20)), (2, "u", s(hours=5), s(hours=6)), (3, None, s(), s(hours=1))], "sid long, u string, a timestamp, b timestamp")
    events = spark.createDataFrame(
        [(1, "u", s()), (2, "u", s(hours=20, milliseconds=400)), (3, "u", s(hours=20, seconds=1)), (4, "u", s(hours=5, minutes=30)), (5, None, s(minutes=1)), (6, "v", s()), (7, "u", None)],
        "eid long, u string, at timestamp",
    )
    got = joins.attribute_to_intervals(events, sessions, ["u"], "at", "a", F.col("b"), "eid", "sid", bucket_hours=1)
    assert rows(got) == [(1, 1), (2, 1), (4, 2), (5, 3)]


def test_next_at_or_after(spark):
    random.seed(4)
    points = [(g, random.randrange(50), i) for i, g in enumerate(random.choices("ab", k=60))]
    marks = [(g, random.randrange(60), i) for i, g in enumerate(random.choices("abc", k=60))]
    ranked = []
    for g in "ab":
        ranked += [(g, x, r) for r, (_, x, _) in enumerate(sorted(p for p in points if p[0] == g), 1)]
    got = dict(rows(joins.next_at_or_after(spark.createDataFrame(ranked, "g string, x long, rk long"), spark.createDataFrame(marks, "g string, mx long, mark long"), "g", "x", "mx", "mark", "rk"), "mark", "rk"))
    for g, x, mark in marks:
        of = [p for p in ranked if p[0] == g]
        want = min((p[2] for p in of if p[1] >= x), default=max((p[2] for p in of), default=None))
        assert got.get(mark) == want


def test_change_classes(spark):
    now = spark.createDataFrame([("n", "a", 1), ("u", "a", 1), ("t", "a", 2), ("c", "b", 2)], "p string, h string, m long")
    was = spark.createDataFrame([("u", "a", 1), ("t", "a", 1), ("c", "a", 1), ("d", "a", 1)], "p string, h string, m long")
    assert rows(joins.change_classes(now, was, "p", "h", "m")) == [("c", "changed"), ("d", "deleted"), ("n", "new"), ("t", "touched"), ("u", "unchanged")]


# --- series


def test_series(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("a", 4, 6), ("b", 1, -3)], "g string, i int, x long")
    assert rows(series.strictly_increasing(df, "g", ["i"], "x"), "g", "i", "x_strict") == [("a", 1, 5), ("a", 2, 6), ("a", 3, 7), ("a", 4, 8), ("b", 1, -3)]
    assert rows(series.running_total(df, "g", ["i"], ["x"]), "g", "i", "total_x") == [("a", 1, 5), ("a", 2, 10), ("a", 3, 10), ("a", 4, 16), ("b", 1, 0)]
    assert spark.createDataFrame([(1,), (2,)], "x long").agg(series.median_integer(F.col("x"))).first()[0] == 1


# --- lifecycle


def test_upsert_and_debounce(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    assert rows(lifecycle.upsert(table, spark.createDataFrame([(2, "B"), (3, "c"), (None, "N"), (3, "c")], "k long, v string"), ["k"])) == [(1, "a"), (2, "B"), (3, "c"), (None, "N")]
    seen = spark.createDataFrame([("x", T0)], "k string, at timestamp")
    new = spark.createDataFrame([("x", T0 + dt.timedelta(minutes=30)), ("y", T0)], "k string, at timestamp")
    assert rows(lifecycle.upsert_where(seen, new, "k", "at", F.expr("interval 1 hour"))) == [("x", T0), ("y", T0)]


def test_supersede_refuses_self_and_unknown(spark):
    table = spark.createDataFrame([(1, None, "active"), (2, None, "active")], "id long, superseded_by long, status string")
    links = spark.createDataFrame([(1, 2), (2, 2), (2, 99)], "id long, superseded_by long")
    assert rows(lifecycle.supersede(table, links, "id", "status"), "id", "superseded_by", "status") == [(1, 2, "superseded"), (2, None, "active")]


def test_expire_and_retention(spark):
    df = spark.createDataFrame([(1, "pending", T0), (2, "pending", T0 - dt.timedelta(seconds=1)), (3, "accepted", T0 - dt.timedelta(9))], "id long, status string, created_at timestamp")
    assert rows(lifecycle.expire(df, F.lit(T0)), "id", "status") == [(1, "pending"), (2, "expired"), (3, "accepted")]
    assert lifecycle.keep_recent(df, "created_at", F.lit(T0), 0).count() == 3 and lifecycle.keep_recent(df, "created_at", F.lit(T0), 5).count() == 1


def test_digest(spark):
    make = lambda data: digest.table_digest(spark.createDataFrame(data, "k long, v string"), "t", ["k"], ["k", "v"]).first()["digest"]
    assert make([(1, "a"), (2, None)]) == make([(2, None), (1, "a")])
    assert len({make([(1, "")]), make([(1, None)]), make([(1, "a")]), make([]), make([(1, ""), (1, "")])}) == 5


# --- chunkers


def test_markdown():
    text = "intro\n# A\none\n```\n# no heading\n```\n## B\ntwo\n# C\n\n"
    assert chunkers.markdown_chunks(text) == [("", "intro"), ("A", "one\n```\n# no heading\n```"), ("A > B", "two")]
    assert chunkers.markdown_chunks(None) == [] and chunkers.markdown_chunks("") == []
    long = chunkers.markdown_chunks("# A\n" + "\n\n".join("x" * 900 for _ in range(5)))
    assert [len(b) for _, b in long] == [1802, 1802, 900]
    assert len(chunkers.markdown_chunks("# A\n" + "x" * 3000)) == 1


def test_line_windows():
    assert [(a, b) for a, b, _ in chunkers.line_windows("\n".join(map(str, range(51))))] == [(1, 50), (51, 51)]
    assert [len(t.encode()) for _, _, t in chunkers.line_windows("ä" * 3000)] == [4000, 2000]
    assert chunkers.line_windows("\n\n") == []


def test_code_chunks():
    py = "import os\n\n@wrap\ndef f():\n    return 1\n\nclass A:\n    x = 1\n    def m(self):\n        pass\n"
    assert [(k, n, a, b) for k, n, a, b, _ in chunkers.code_chunks(py, "python")] == [("function", "f", 3, 5), ("type", "A", 7, 8), ("method", "A::m", 9, 10)]
    rust = "// doc\nfn a() {\n  x();\n}\nstruct S {\n}\n"
    assert [(k, n, a, b) for k, n, a, b, _ in chunkers.code_chunks(rust, "rust")] == [("function", "a", 1, 4), ("type", "S", 5, 6)]
    assert chunkers.code_chunks("def broken(:", "python")[0][0] == "line-window" and chunkers.code_chunks("x", None)[0][0] == "line-window"
