"""Queries of problem 10: repetition inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.repetition import repetition
from earshot.sources.tables import table


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    """Distances and repeated share of every document."""
    return repetition(table(spark, folder, "documents"), "doc_id", "text", "lang")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of every document that repeats what it has already said."""
    return p10_report(spark, folder).select("doc_id", "n_words", F.round("share", 6).alias("share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which at least 0.4 of the words lie in repeated runs of five words: of those that stray, the ones whose exact share says so."""
    suspects = repetition(table(spark, folder, "documents"), "doc_id", "text", "lang", only_suspects=True)
    return suspects.where("share >= 0.4").select("doc_id").distinct()


P10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
a AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM a CROSS JOIN (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id)
"""
P10_FOUND_SQL = P10_SQL + "SELECT DISTINCT doc_id FROM c JOIN w USING (doc_id) WHERE n >= 0.4 * len(w)"
P10_SHARES_SQL = P10_SQL + """SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, round(coalesce(n / len(w), 0.0), 6) AS share
FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

QUERIES = {"p10_found": p10_found, "p10_report": p10_report, "p10_shares": p10_shares}
SQL = {"p10_found": P10_FOUND_SQL, "p10_shares": P10_SHARES_SQL}
