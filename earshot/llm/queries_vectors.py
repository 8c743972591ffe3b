"""Queries of problem 5: similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.neighbours import most_similar
from earshot.sources.tables import table

DIM = 64


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of utterances, and of chunks, of which one is among the three most similar of the other."""
    parts = []
    for src, key in (("utterances", F.concat("file_id", F.lit(":"), "idx")), ("chunks", F.col("id"))):
        links = most_similar(table(spark, folder, src).select(key.alias("id"), "embedding"), "id", "embedding", dim=DIM, min_cosine=0.9)
        parts.append(links.select(F.lit(src).alias("src"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")))
    return parts[0].unionByName(parts[1]).distinct()


P5_SQL = """
WITH v AS (SELECT DISTINCT 'utterances' AS src, file_id || ':' || idx AS id, embedding AS e FROM utterances
           UNION SELECT DISTINCT 'chunks', id, embedding FROM chunks),
f AS (SELECT src, id, CAST(e AS DOUBLE[64]) AS e FROM v WHERE len(e) = 64 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
p AS (SELECT a.src, a.id AS id, b.id AS other, array_cosine_similarity(a.e, b.e) AS c FROM f a JOIN f b ON a.src = b.src AND a.id <> b.id),
k AS (SELECT * FROM p WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY src, id ORDER BY c DESC, other) <= 3)
SELECT DISTINCT src, least(id, other) AS id_a, greatest(id, other) AS id_b FROM k
"""

QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": P5_SQL}
