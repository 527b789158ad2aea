import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from kelpie.operators import rolling

SESSIONS = (
    "session_id string, project_id long, agent string, started_at timestamp, ended_at timestamp, input_tokens long, output_tokens long, "
    "last_scanned_offset long, day string"
)
REPORTS = "report_id long, project_id long, report_day date, " + ", ".join(
    f"totals_{w}d_{m} long" for w in (7, 30) for m in rolling.MEASURES
) + ", avg_7d_input_tokens double, avg_30d_input_tokens double"


def session(key, project, day, tokens, offset=1, hour=12):
    at = None if day is None else dt.datetime(2026, 1, 1, hour) + dt.timedelta(days=day)
    return (key, project, "a", None, at, tokens, tokens, offset, "clash")


def test_brute_force(spark):
    random.seed(1)
    data = [session(f"s{random.randrange(80)}", random.choice([1, 1, 1, 2, None]), random.choice([None, *range(60)]), random.randrange(100), random.choice([None, 1, 2])) for _ in range(300)]
    df = spark.createDataFrame(data, SESSIONS)
    kept = {}
    for s in data:
        key = (-1 if s[7] is None else s[7], s[4] or dt.datetime.min, -1 if s[1] is None else s[1], s[5])
        if s[0] not in kept or key > kept[s[0]][0]:
            kept[s[0]] = (key, s)
    found = {(r["project_id"], r["day"]): r for r in rolling.rolling_totals(rolling.session_days(df), "project_id", rolling.MEASURES).collect()}
    closed = [s for _, s in kept.values() if s[4]]
    assert found
    for (project, day), r in found.items():
        for w in (7, 30):
            inside = [s for s in closed if s[1] == project and day - dt.timedelta(days=w) < s[4].date() <= day]
            assert (r[f"total_{w}d_sessions"], r[f"total_{w}d_input_tokens"]) == (len(inside), sum(s[5] for s in inside))
    last = max(s[4].date() for s in closed if s[1] == 1)
    assert (1, last + dt.timedelta(days=29)) in found and (1, last + dt.timedelta(days=30)) not in found


def test_reports(spark):
    sessions = spark.createDataFrame([session("a", 1, 0, 70), session("a", 1, 0, 7, None), session("b", 1, 6, 7), session("c", 1, None, 5)], SESSIONS)
    day = dt.date(2026, 1, 7)
    right = (2, 77, 77, 2, 77, 77, 11.0, 77 / 30)
    data = [(1, 1, day, *right), (2, 1, day, *right[:6], 11.01, 77 / 30), (3, 1, day, 3, *right[1:]), (4, 1, day, *right[:6], None, 77 / 30), (5, 9, day, 0, 0, 0, 0, 0, 0, 0.0, 0.0), (6, 1, day, None, *right[1:])]
    wrong = rolling.wrong_reports(spark.createDataFrame([*data, data[2]], REPORTS), sessions)
    assert rows(wrong) == [(3,), (4,), (6,)]


def test_empty(spark):
    empty = spark.createDataFrame([], SESSIONS)
    assert rolling.rolling_totals(rolling.session_days(empty), "project_id", rolling.MEASURES).count() == 0
    assert rolling.wrong_reports(spark.createDataFrame([], REPORTS), empty).count() == 0


def test_hot_key_and_window_edges(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id")).alias("session_id"), F.lit(1).cast("long").alias("project_id"), F.lit("2026-01-01 23:59:59").cast("timestamp").alias("ended_at"),
        F.lit(1).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("last_scanned_offset"),
    )
    totals = {r["day"].day: (r["total_7d_sessions"], r["total_7d_output_tokens"]) for r in rolling.rolling_totals(rolling.session_days(df), "project_id", rolling.MEASURES).collect()}
    assert totals[7] == (3000, 0) and totals[8] == (0, 0)
