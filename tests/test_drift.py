import datetime as dt
import itertools
import json
import random

from conftest import rows

from kelpie.operators import drift
from kelpie.operators.ordering import previous_in_group
from pyspark.sql import functions as F

FILES = "file_id long, stream_id long, opened_at timestamp, path string"
LINES = "file_id long, line_no long, raw_line string, read_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def usage(i, **names):
    base = {"input_tokens": 100 + i, "output_tokens": 10 + i, "cache_read_input_tokens": 9000 + i}
    return {names.get(k, k): v for k, v in base.items()}


def tables(spark, versions, extra_lines=()):
    files = [(10 - i, 1, T0 + dt.timedelta(hours=5 * i), "p") for i in range(len(versions))]
    lines = [(10 - i, n, json.dumps(make(n)) if not isinstance(make(n), str) else make(n), T0) for i, make in enumerate(versions) for n in range(1, 7)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame([*lines, *extra_lines], LINES)


def changes(spark, versions, **more):
    files, lines = tables(spark, versions, **more)
    return rows(drift.schema_changes(files, drift.profile_fields(lines)))


def test_changes(spark):
    ts = lambda n: f"2026-01-01T00:0{n}:00.000Z"
    v0 = lambda n: {"timestamp": ts(n), "message": {"usage": usage(n), "model": "quill"}, "flag": None}
    v1 = lambda n: {"ts": ts(n), "message": {"usage": usage(n), "model": "quill"}, "isReplay": True}
    v2 = lambda n: {"ts": ts(n), "msg": {"usage": usage(n, input_tokens="prompt_tokens"), "model": "quill"}, "isReplay": True}
    v3 = lambda n: {"ts": ts(n), "msg": {"usage": {k: str(v) for k, v in usage(n, input_tokens="prompt_tokens").items()}}, "isReplay": True}
    found = changes(spark, [v0, v1, v2, v3], extra_lines=[(10, 7, "{broken", T0), (10, 8, "  ", T0), (10, 9, None, T0), (10, 1, json.dumps(v0(1)), T0), (10, 11, "[1]", T0)])
    assert found == sorted([
        (9, "timestamp", "ts"), (9, "", "isReplay"),
        (8, "message.usage.input_tokens", "msg.usage.prompt_tokens"), (8, "message.usage.output_tokens", "msg.usage.output_tokens"),
        (8, "message.usage.cache_read_input_tokens", "msg.usage.cache_read_input_tokens"), (8, "message.model", "msg.model"),
        (7, "msg.model", ""), *[(7, f"msg.usage.{k}", f"msg.usage.{k}") for k in ("prompt_tokens", "output_tokens", "cache_read_input_tokens")],
    ], key=repr)


def test_other_meaning_is_no_rename(spark):
    v0 = lambda n: {"cwd": f"/work/{n}", "k": 1}
    v1 = lambda n: {"note": f"some words of prose number {n}, and more of them", "k": 1}
    assert changes(spark, [v0, v1]) == [(9, "", "note"), (9, "cwd", "")]


def test_unified_turns(spark):
    v0 = lambda n: {"timestamp": f"2026-01-01T00:0{n}:00Z", "sessionId": "s", "message": {"usage": usage(n)}}
    v1 = lambda n: {"timestamp": f"2026-01-01T00:0{n}:00Z", "sessionId": "s", "message": {"usage": usage(n, input_tokens="in_tok")}}
    v2 = lambda n: {"timestamp": f"2026-01-01T00:0{n}:00Z", "sessionId": "s", "message": {"usage": usage(n, input_tokens="promptTokenCount", output_tokens="out_tok")}}
    files, lines = tables(spark, [v0, v1, v2], [(8, 7, "{broken", T0), (8, 8, " ", T0), (8, 1, json.dumps(v2(5)), T0 + dt.timedelta(1))])
    fields = drift.profile_fields(lines)
    turns = drift.unified_turns(files, lines, fields, drift.schema_changes(files, fields))
    got = rows(turns, "file_id", "line_no", "parsed", "input_tokens", "output_tokens", "cache_read_tokens")
    want = [(f, n, True, 100 + n, 10 + n, 9000 + n) for f in (8, 9, 10) for n in range(1, 7) if (f, n) != (8, 1)]
    want += [(8, 1, True, 105, 15, 9005), (8, 7, False, None, None, None), (8, 8, None, None, None, None)]
    assert got == sorted(want, key=repr)
    assert turns.where("ts is null").count() == 2 and turns.where("session_id = 's'").count() == 18


def test_empty(spark):
    files, lines = spark.createDataFrame([], FILES), spark.createDataFrame([], LINES)
    fields = drift.profile_fields(lines)
    made = drift.schema_changes(files, fields)
    assert made.count() == 0 and drift.unified_turns(files, lines, fields, made).count() == 0


def test_assignment_is_optimal():
    random.seed(2)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        weights = [[random.random() for _ in range(m)] for _ in range(n)]
        got = sum(weights[i][j] for i, j in enumerate(drift.assign(weights)) if j >= 0)
        wide, long = (weights, (n, m)) if n <= m else ([list(c) for c in zip(*weights)], (m, n))
        assert abs(got - max(sum(wide[i][p[i]] for i in range(long[0])) for p in itertools.permutations(range(long[1]), long[0]))) < 1e-9


def test_previous_in_group(spark):
    random.seed(3)
    data = [(i, random.choice([1, 1, 1, 2, None]), T0 + dt.timedelta(minutes=random.randrange(400))) for i in range(200)] + [(900, 1, None)]
    df = spark.createDataFrame(data, "id long, g long, at timestamp")
    out = {r["id"]: r["prev"] for r in previous_in_group(df, "g", "at", F.date_trunc("hour", "at"), "id", "prev").collect()}
    for g in (1, 2, None):
        order = sorted((d for d in data if d[1] == g), key=lambda d: (d[2] is not None, d[2] or T0, d[0]))
        assert [out[d[0]] for d in order] == [None, *[d[0] for d in order[:-1]]]
