import json
import subprocess
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kelpie.sources import exchange, files, git_log, store, transcripts
from kelpie.streaming.growing_files import GrowingFiles


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    facts = spark.createDataFrame([(1, "a", None), (2, None, 5)], "id long, key string, superseded_by long").withColumn("kind", F.lit(None).cast("string"))
    s.save({"facts": facts})
    again = store.Store(spark, str(tmp_path / "s"))
    assert rows(again.table("facts")) == rows(facts)
    again.save({"facts": facts.where("id = 1"), "notes": facts})
    assert again.table("facts").count() == 1 and again.collect_garbage() == 1
    with pytest.raises(store.StoreError):
        s.save({"facts": facts})  # its version is old
    name = store.snapshot(again, str(tmp_path / "snap"))
    target = store.Store(spark, str(tmp_path / "t"))
    store.adopt(target, str(tmp_path / "snap" / name))
    assert target.digests() == again.digests()
    facts.write.mode("overwrite").parquet(str(tmp_path / "snap" / name / "facts"))
    with pytest.raises(store.StoreError):
        store.adopt(target, str(tmp_path / "snap" / name))
    assert store.Store.open_if_exists(spark, str(tmp_path / "none")) is None
    (tmp_path / "p" / ".store").mkdir(parents=True)
    store.Store(spark, str(tmp_path / "p" / ".store")).save({"facts": facts})
    assert store.Store.discover(spark, str(tmp_path / "p")).table("facts").count() == 2


def test_migration(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.save({"facts": spark.createDataFrame([(1,)], "id long")})
    note = json.loads((tmp_path / "manifest.json").read_text())
    (tmp_path / "manifest.json").write_text(json.dumps({**note, "schema_version": 1}))
    assert store.Store(spark, str(tmp_path)).table("facts").columns == ["id", "superseded_by", "kind"]
    (tmp_path / "manifest.json").write_text(json.dumps({**note, "schema_version": 99}))
    with pytest.raises(store.StoreError):
        store.Store(spark, str(tmp_path))


def test_export_import(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "a"))
    s.save({"facts": spark.createDataFrame([(2, 'x"y\n'), (1, None)], "id long, v string"), "empty": spark.createDataFrame([], "id long")})
    exchange.export_json(s, str(tmp_path / "x.json"), "tests")
    t = store.Store(spark, str(tmp_path / "b"))
    assert exchange.import_json(t, str(tmp_path / "x.json")) == ["empty", "facts"]
    assert t.digests() == s.digests()
    with pytest.raises(store.StoreError):
        exchange.import_json(t, str(tmp_path / "x.json"))
    exchange.import_json(t, str(tmp_path / "x.json"), force=True)


def test_golden(spark, tmp_path):
    good = {"version": 1, "queries": [{"id": "a", "query": "q", "kind": "match", "title_contains": ["t"]}, {"id": "b", "query": "q", "kind": "empty"}]}
    (tmp_path / "g.json").write_text(json.dumps(good))
    assert exchange.load_golden(spark, str(tmp_path / "g.json")).count() == 2
    good["queries"][0].pop("title_contains")
    (tmp_path / "h.json").write_text(json.dumps(good))
    with pytest.raises(ValueError):
        exchange.load_golden(spark, str(tmp_path / "h.json"))


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\n" * 20)
    (tmp_path / "k.pem").write_text("x")
    run("add", "."), run("commit", "-qm", "first")
    run("mv", "a.txt", "b.txt"), run("commit", "-qm", "second")
    log = git_log.read_log(spark, str(tmp_path))
    assert rows(log, "message", "change_type", "path") == [("first", "A", "a.txt"), ("first", "A", "k.pem"), ("second", "R", "b.txt")]
    assert git_log.head(str(tmp_path)) and rows(files.tracked_files(spark, str(tmp_path), ["*.pem"])) == [("b.txt",)]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_text("text\n## The title ##\n")
    (tmp_path / "y.md").write_text("none")
    (tmp_path / "z.md").write_bytes(b"\xff\xfe\xff")
    assert rows(files.markdown_documents(spark, str(tmp_path)), "path", "title", "byte_len") == [("d/x.md", "The title", 21), ("y.md", "y", 4)]


def test_settings(tmp_path):
    chosen = files.Settings(mode="hybrid", pool=5, deny=("a\"b",))
    files.save_settings(chosen, str(tmp_path / "c.toml"))
    assert files.load_settings(str(tmp_path / "c.toml")) == chosen
    for bad in ("nope = 1", 'pool = "x"'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            files.load_settings(str(tmp_path / "bad.toml"))
    for args in ({"limit": 0}, {"status": "?"}, {"actor": "nobody"}):
        with pytest.raises(ValueError):
            store.validate(**args)


LINES = [
    '{"timestamp":"2026-01-01T00:00:00.000Z","message":{"usage":{"input_tokens":5,"output_tokens":"7"}}}', '{"usage":{"cache_read_input_tokens":3}}', "{bad", "", "[1]",
    '{"type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":1,"output_tokens":2,"reasoning_output_tokens":3,"cached_input_tokens":4}}}}', None,
]


def test_transcripts(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no long, raw_line string")
    assert rows(transcripts.message_usage(df), "line_no", "input", "output", "cache_read") == [(0, 5, 7, 0), (1, 0, 0, 3)]
    assert rows(transcripts.event_usage(df), "line_no", "input", "output", "cache_read") == [(5, 1, 5, 4)]
    assert df.where(transcripts.is_damaged(F.col("raw_line"))).count() == 2


def test_growing_files(spark, tmp_path):
    spark.dataSource.register(GrowingFiles)
    log = tmp_path / "a.jsonl"

    def run():
        out = tmp_path / "out"
        stream = spark.readStream.format("growing_files").load(str(tmp_path / "*.jsonl"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return [(r[0], r[1]) for r in spark.read.parquet(str(out)).orderBy("generation", "byte_offset").select("generation", "raw_line").collect()]

    log.write_text("one\ntwo\npart")
    assert run() == [(0, "one"), (0, "two")]
    with log.open("a") as f:
        f.write("ial\nthree\n")
    assert run() == [(0, "one"), (0, "two"), (0, "partial"), (0, "three")]
    assert len(run()) == 4
    log.write_text("new\n")
    assert run()[-1] == (1, "new")


def test_clock_is_a_parameter():
    package = Path(store.__file__).resolve().parents[1]
    assert not [p for p in package.rglob("*.py") if "current_timestamp" in p.read_text() or "datetime.now" in p.read_text()]


def test_stretches_of_a_growing_file(tmp_path, monkeypatch):
    from kelpie.streaming import growing_files

    path = tmp_path / "a.jsonl"
    lines = ["x" * n for n in (0, 3, 40, 1, 0, 0, 9, 120, 2)]
    path.write_text("".join(line + "\n" for line in lines) + "unfinished")
    for stretch in (1, 2, 5, 7, 50, 1000):
        monkeypatch.setattr(growing_files, "STRETCH", stretch)
        reader = growing_files.GrowingFileReader(str(path))
        end = reader.latestOffset()
        found = [row for part in reader.partitions({}, end) for row in reader.read(part)]
        assert [r[3] for r in found] == lines and [r[2] for r in found] == [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))], stretch
        later = reader.partitions({str(path): [5, 0]}, end)
        assert [r[3] for part in later for r in reader.read(part)] == lines[2:]


def test_documents_in_another_layout(spark, tmp_path):
    from kelpie.sources import exchange
    from kelpie.sources.store import Store

    store = Store(spark, str(tmp_path / "s"))
    odd = spark.createDataFrame([(2, 'a "q" \n ]'), (1, None), (3, ",{")], "id long, text string")
    store.save({"notes": odd, "none": odd.limit(0)})
    exchange.export_json(store, str(tmp_path / "e.json"), "user")
    document = json.loads((tmp_path / "e.json").read_text())
    assert [r["id"] for r in document["notes"]] == [1, 2, 3] and document["none"] == []
    (tmp_path / "one.json").write_text(json.dumps(document))
    for name in ("e.json", "one.json"):
        other = Store(spark, str(tmp_path / name[:-5]))
        assert sorted(exchange.import_json(other, str(tmp_path / name))) == ["none", "notes"]
        assert sorted(map(tuple, other.table("notes").collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr) and other.table("none").isEmpty()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e", "e.json", "one", "one.json", "s"]
