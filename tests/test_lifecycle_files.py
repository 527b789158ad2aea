import datetime as dt
import json

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpie.functions.jsonc import strip_line_comments
from kelpie.operators import embedding, options, reports
from kelpie.sources import code_index, files, registry, report_files


def stripped(line):
    quoted = False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == "/" and not quoted and line[i : i + 2] == "//":
            return line[:i]
    return line


def test_comments(spark):
    texts = ['{"a": "x//y", // note\n "b": 1} // end', '"open // stays', "// all", "a / b", "", None, '"a"//"b"', "/" * 5001, '"a" ' * 3000 + "// b", "///", '"x" / "//" // y']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", strip_line_comments(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: None if t is None else "\n".join(map(stripped, t.split("\n"))) for i, t in enumerate(texts)}
    assert json.loads(got[0]["s"]) == {"a": "x//y", "b": 1}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), max_size=9))
def test_bytes_of_floats(values):
    assert np.frombuffer(np.asarray(values, dtype="<f4").tobytes(), dtype="<f4").tolist() == [float(np.float32(v)) for v in values]


def test_vector_bytes(spark):
    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, []), (3, None)], "id long, vector array<float>")
    packed = embedding.with_bytes(df, "vector")
    assert {r["id"]: r["blob"] and bytes(r["blob"]) for r in packed.collect()} == {1: b"\x00\x00\x80?\x00\x00 \xc0", 2: b"", 3: None}
    cut = packed.select("id", F.expr("blob || x'01'").alias("blob"))
    assert rows(embedding.with_vector(cut, "blob"), "id", "vector") == [(1, [1.0, -2.5]), (2, []), (3, None)]


def test_embedding(spark):
    class Counting(embedding.HashedWords):
        def embed(self, texts):
            assert len(texts) <= 16
            return super().embed(texts)

    texts = [(i, f"word{i % 40} and more") for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["vector"] for r in embedding.embed(df, "id", "text", Counting(16)).collect()}
    assert len(got) == 102 and got[0] == got[40] != got[1] and not any(got[200]) and abs(np.linalg.norm(got[5]) - 1) < 1e-6
    first = embedding.embed_missing(df, spark.createDataFrame([], "id long, content_hash string"), "id", "text", Counting(16))
    assert first.count() == 102
    changed = df.withColumn("text", F.when(F.col("id") == 3, "new").otherwise(F.col("text")))
    assert rows(embedding.embed_missing(changed, first, "id", "text", Counting(16)), "id") == [(3,)]


def test_options():
    given_, base = options.RecallOptions, files.Settings()
    with pytest.raises(ValueError):
        options.resolve(given_("  "), base)
    with pytest.raises(ValueError):
        options.resolve(given_("x", max_results=-1), base)
    with pytest.raises(ValueError):
        options.resolve(given_("x", source_types=("what",)), base)
    plain = options.resolve(given_(" x "), base)
    assert (plain.query, plain.max_results, plain.pool, plain.source_types, plain.docs_via_default, plain.mode) == ("x", 6, 20, ("fact", "decision", "task"), False, "fts")
    docs = options.resolve(given_("x", max_results=50), files.Settings(docs_by_default=True))
    assert docs.pool == 50 and docs.source_types[-1] == "doc_chunk" and docs.docs_via_default
    named = options.resolve(given_("x", source_types=("task", "fact", "task"), use_reranker=False), files.Settings(docs_by_default=True))
    assert named.source_types == ("task", "fact") and not named.docs_via_default and not named.use_reranker
    assert files.setting_problems(base) == [] and len(files.setting_problems(files.Settings(mode="x", pool=0, text_weight=2.0))) == 3


def test_registry(spark, tmp_path):
    at = lambda minute: dt.datetime(2026, 1, 1, 10, 0) + dt.timedelta(minutes=minute)
    known = spark.createDataFrame([("old", at(-61), "3"), ("hour", at(-60), "3"), ("fresh", at(-1), "3"), ("schema", at(-1), "2")], "root_path string, last_seen timestamp, last_schema string")
    opened = spark.createDataFrame([(p, "3") for p in ("old", "hour", "fresh", "schema", "new", "new")], "root_path string, last_schema string")
    got = {r["root_path"]: (r["last_seen"] == at(0), r["last_schema"]) for r in registry.register(known, opened, F.lit(at(0))).collect()}
    assert got == {"old": (True, "3"), "hour": (False, "3"), "fresh": (False, "3"), "schema": (True, "3"), "new": (True, "3")}
    assert all(r["last_seen"] == at(0) for r in registry.register(known, opened, F.lit(at(0)), explicit=True).collect())
    (tmp_path / "a" / ".store").mkdir(parents=True)
    (tmp_path / "a" / ".store" / "manifest.json").write_text("{}")
    both = spark.createDataFrame([(str(tmp_path / x), at(0), "3") for x in "ab"], known.schema)
    live = registry.live_roots(both)
    assert live == [str(tmp_path / "a")] and registry.prune(both, spark.createDataFrame([(p,) for p in live], "root_path string")).count() == 1


def test_reports_are_written_together(spark, tmp_path, monkeypatch):
    notes = spark.createDataFrame([(1, "a\n b", dt.datetime(2026, 1, 1), "user"), (2, "c", dt.datetime(2026, 1, 2), "user")], "id long, text string, created_at timestamp, actor string")
    state = spark.createDataFrame([("## Now\n\nbody\n\n", dt.datetime(2026, 1, 1), "user")], "body string, created_at timestamp, actor string")
    page = reports.page([("Now", reports.narrative_lines(state)), ("Notes", reports.note_lines(notes, 5)), ("None", reports.note_lines(notes.limit(0), 5))], "P")
    text = report_files.report_text(page)
    assert text == "# P\n\n## Now\n\nbody\n\n_Last updated 2026-01-01 00:00:00 by user._\n\n## Notes\n\n- **2026-01-02 00:00:00** (user) — c\n- **2026-01-01 00:00:00** (user) — a b\n\n## None\n\n_Nothing recorded._\n"
    folder = str(tmp_path / "out")
    assert report_files.write_reports(folder, {"b.md": "old b", "a.md": "old a"}) == ["a.md", "b.md"]
    real, calls = report_files.os.replace, []

    def failing(source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("full")
        return real(source, target)

    monkeypatch.setattr(report_files.os, "replace", failing)
    with pytest.raises(OSError):
        report_files.write_reports(folder, {"a.md": "new a", "b.md": "new b"})
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "old a", "b.md": "old b"}


def test_code_index(spark, tmp_path):
    def tree(*rows_):
        return spark.createDataFrame([(p, m, len(t), str(hash(t)), t) for p, m, t in rows_], "path string, mtime long, size long, content_hash string, text string")

    index = code_index.CodeIndex(spark, str(tmp_path / "index"))
    assert index.status() == code_index.IndexStatus(False) and index.remove() is False
    body = "def f(x):\n    return x\n"
    first = index.refresh(tree(("a.py", 1, body), ("b.py", 1, body + body.replace(" f(", " g(")), ("c.min.js", 1, "x"), ("d.txt", 1, "x"), ("secrets/e.py", 1, body)), ["secrets/**"], "c0ffee")
    assert rows(first) == [("new", 2)] and index.status() == code_index.IndexStatus(True, 2, 3, 0, "c0ffee")
    assert index.embed(embedding.HashedWords(8)) == 3 and index.embed(embedding.HashedWords(8)) == 0
    second = index.refresh(tree(("a.py", 2, body), ("n.py", 1, body)), [], "beef")
    assert rows(second) == [("deleted", 1), ("new", 1), ("touched", 1)]
    assert index.embed(embedding.HashedWords(8)) == 1 and index.status() == code_index.IndexStatus(True, 2, 2, 2, "beef")
    assert index.remove() and not index.exists()
