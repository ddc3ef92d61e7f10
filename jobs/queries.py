"""The jobs as queries: each runs twice into a new folder under the shared one and returns what then stands there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import run_status, unique_lines
from planarflow.sources.folders import new_folder


def job1_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = new_folder(spark, "job1", stays=True)
    for _ in range(2):
        run_status.run(spark, f"{sf_dir}/events.parquet*", f"{home}/out", f"{home}/marks")
    return run_status.result(spark, f"{home}/out")


def job2_unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = new_folder(spark, "job2", stays=True)
    for _ in range(2):
        unique_lines.run(spark, f"{sf_dir}/documents.parquet", home)
    return unique_lines.result(spark, home)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_run_status, job2_unique_lines)}

ORACLE_SQL: dict[str, str] = {
    "job1_run_status": r"""
WITH e AS (
  SELECT DISTINCT event_id, ts, user_id, coalesce(event_type, 'unknown') AS event_type, value, props, CAST(ts AS DATE) AS day FROM events WHERE ts IS NOT NULL
), x AS (
  SELECT *, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS s, TRY_CAST(nullif(regexp_extract(props, '"k": *(-?\d+)', 1), '') AS BIGINT) AS k FROM e
), gap AS (
  SELECT day, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY day, user_id ORDER BY ts) > 300000000 AS silent FROM e
), silence AS (SELECT day, count(*) FILTER (silent) AS silences FROM gap GROUP BY day)
SELECT x.day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, max(value) AS highest,
  CAST(coalesce(sum(k), 0) AS BIGINT) AS counter, count(*) FILTER (k IS NULL) AS bare, min(s) AS first_second, max(s) AS last_second,
  CASE WHEN event_type IS NULL THEN any_value(silences) END AS silences
FROM x JOIN silence USING (day) GROUP BY GROUPING SETS ((x.day, event_type), (x.day))
""",
    "job2_unique_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents),
u AS (SELECT substr(sha256(line), 1, 2) AS bucket, line, count(*) AS n, min(doc_id) AS first_doc FROM l WHERE line <> '' GROUP BY line)
SELECT bucket, row_number() OVER (ORDER BY bucket, line) - 1 AS row, row_number() OVER (PARTITION BY bucket ORDER BY line) - 1 AS place, line, n, first_doc,
  count(*) OVER b AS records, CAST(sum(octet_length(encode(line)) + 1) OVER b AS BIGINT) AS bytes,
  CAST(sum(CAST('0x' || substr(sha256(line), 1, 12) AS BIGINT)) OVER b % 281474976710656 AS BIGINT) AS checksum
FROM u WINDOW b AS (PARTITION BY bucket)
""",
}
