"""Queries of problem 3: covered periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.intervals import periods_and_gaps
from earshot.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of each recording, from its utterances and from its chunks."""
    parts = [
        table(spark, folder, src).select(F.lit(src).alias("src"), "file_id", "start_sec", "end_sec")
        for src in ("utterances", "chunks")
    ]
    return periods_and_gaps(parts[0].unionByName(parts[1]), ["src", "file_id"], "start_sec", "end_sec")


P3_SQL = """
WITH iv AS (
  SELECT 'utterances' AS src, file_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e
  FROM utterances WHERE end_sec > start_sec AND file_id IS NOT NULL
  UNION ALL
  SELECT 'chunks', file_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round(end_sec * 1000) AS BIGINT)
  FROM chunks WHERE end_sec > start_sec AND file_id IS NOT NULL),
r AS (SELECT *, max(e) OVER (PARTITION BY src, file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN s <= reach + 500 THEN 0 ELSE 1 END)
        OVER (PARTITION BY src, file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM r),
p AS (SELECT src, file_id, min(s) AS s, max(e) AS e FROM g GROUP BY src, file_id, run),
n AS (SELECT *, lead(s) OVER (PARTITION BY src, file_id ORDER BY s) AS nxt FROM p)
SELECT src, file_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM n
UNION ALL
SELECT src, file_id, 'gap', e, nxt FROM n WHERE nxt - e <= 3600000
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
