"""Queries of the general data problems: schema drift (p4) and rolling totals (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpie.operators import drift, rolling
from kelpie.session import cut, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = cut(drift.profile_fields(table(spark, sf_dir, "transcript_lines")))
    return drift.schema_changes(table(spark, sf_dir, "transcript_files"), fields)


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lines = table(spark, sf_dir, "transcript_files"), table(spark, sf_dir, "transcript_lines")
    fields = cut(drift.profile_fields(lines))
    changes = cut(drift.schema_changes(files, fields))
    return drift.unified_turns(files, lines, fields, changes)


def p5_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = rolling.session_days(table(spark, sf_dir, "session_metrics"))
    return rolling.rolling_totals(days, "project_id", rolling.MEASURES, (7, 30), ["input_tokens"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.wrong_reports(table(spark, sf_dir, "metrics_tool_data"), table(spark, sf_dir, "session_metrics"))


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns, "p5_found": p5_found, "p5_rolling_totals": p5_rolling_totals}

_DAILY = """
latest AS (
  SELECT project_id, ended_at, input_tokens, output_tokens FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_scanned_offset DESC NULLS LAST, ended_at DESC NULLS LAST,
      project_id DESC NULLS LAST, input_tokens DESC NULLS LAST, output_tokens DESC NULLS LAST) AS rn
    FROM session_metrics) WHERE rn = 1 AND ended_at IS NOT NULL),
daily AS (
  SELECT project_id, CAST(ended_at AT TIME ZONE 'UTC' AS DATE) AS day, COUNT(*) AS n, SUM(input_tokens) AS i, SUM(output_tokens) AS o
  FROM latest GROUP BY 1, 2)"""

_FIGURES = ", ".join(
    f"CAST(COALESCE(SUM(d.{c}) FILTER (WHERE d.day > {{at}} - {w}), 0) AS BIGINT) AS total_{w}d_{m}"
    for w in (7, 30)
    for c, m in (("n", "sessions"), ("i", "input_tokens"), ("o", "output_tokens"))
)

SQL = {
    "p5_found": f"""
WITH {_DAILY},
truth AS (
  SELECT r.report_id, {_FIGURES.format(at="r.report_day")}
  FROM metrics_tool_data r LEFT JOIN daily d
    ON d.project_id = r.project_id AND d.day <= r.report_day AND d.day > r.report_day - 30
  GROUP BY r.report_id)
SELECT DISTINCT r.report_id FROM metrics_tool_data r JOIN truth t USING (report_id)
WHERE totals_7d_sessions IS DISTINCT FROM total_7d_sessions OR totals_7d_input_tokens IS DISTINCT FROM total_7d_input_tokens
  OR totals_7d_output_tokens IS DISTINCT FROM total_7d_output_tokens OR totals_30d_sessions IS DISTINCT FROM total_30d_sessions
  OR totals_30d_input_tokens IS DISTINCT FROM total_30d_input_tokens OR totals_30d_output_tokens IS DISTINCT FROM total_30d_output_tokens
  OR COALESCE(abs(avg_7d_input_tokens - total_7d_input_tokens / 7.0) > 0.02, TRUE)
  OR COALESCE(abs(avg_30d_input_tokens - total_30d_input_tokens / 30.0) > 0.02, TRUE)""",
    "p5_rolling_totals": f"""
WITH {_DAILY},
days AS (
  SELECT project_id, unnest(generate_series(MIN(day)::TIMESTAMP, (MAX(day) + 29)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY 1),
sums AS (
  SELECT a.project_id, a.day, {_FIGURES.format(at="a.day")}
  FROM days a JOIN daily d ON d.project_id = a.project_id AND d.day <= a.day AND d.day > a.day - 30
  GROUP BY 1, 2),
dense AS (
  SELECT a.project_id, a.day, {", ".join(f"COALESCE(total_{w}d_{m}, 0) AS total_{w}d_{m}" for w in (7, 30) for m in ("sessions", "input_tokens", "output_tokens"))}
  FROM days a LEFT JOIN sums s ON s.project_id = a.project_id AND s.day = a.day)
SELECT *, total_7d_input_tokens / 7.0 AS mean_7d_input_tokens, total_30d_input_tokens / 30.0 AS mean_30d_input_tokens FROM dense""",
}
