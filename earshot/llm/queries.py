"""Queries of the problems that prepare training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import fusion, nearest, queries_repetition, queries_sizes, queries_turns, queries_vectors, terms
from earshot.operators.versions import latest
from earshot.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The utterance that starts nearest to either end of each hit."""
    hits = latest(table(spark, folder, "hits"), ["hit_id"], "logged_at", ["file_id", "start_sec", "end_sec"])
    ends = F.array(*[F.struct(F.lit(e).alias("edge"), F.col(f"{e}_sec").alias("edge_sec")) for e in ("start", "end")])
    edges = hits.select("hit_id", "file_id", F.inline(ends))
    found = nearest.nearest_in_time(
        edges,
        table(spark, folder, "utterances"),
        entity="file_id",
        left_time="edge_sec",
        right_time="start_sec",
        right_id="idx",
        tolerance_sec=2.0,
    )
    return found.select("hit_id", "edge", "file_id", "idx")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The leading term of each probe passage, scored against all passages."""
    chunks = latest(table(spark, folder, "chunks"), ["id"], "ingested_at", ["text"])
    probes = table(spark, folder, "chunk_probes").select(F.col("chunk_id").alias("id"))
    scores = terms.distinctive_terms(chunks, "id", "text", wanted=probes)
    return terms.leading_terms(scores, "id").select(F.col("id").alias("chunk_id"), "term")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How characteristic every term of every passage is of it."""
    chunks = latest(table(spark, folder, "chunks"), ["id"], "ingested_at", ["text"])
    scores = terms.distinctive_terms(chunks, "id", "text")
    return scores.select(F.col("id").alias("chunk_id"), "term", "observed", F.round("score", 4).alias("score"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and passages of every term, and whether it is of use.

    The passages come in two batches, those ingested in the first half of the time and what came later: new passages, and
    old ones again. The second is merged as signed changes into the counts of the first.
    """
    feed = table(spark, folder, "chunks")
    span = feed.agg(F.unix_micros(F.min("ingested_at")).alias("a"), F.unix_micros(F.max("ingested_at")).alias("b")).first()
    half = 0 if span.a is None else (span.a + span.b) // 2
    later = (F.unix_micros("ingested_at") > half).cast("int")
    state = terms.term_counts(spark, feed, "id", "text", "ingested_at", batch=later, batches=2)
    return terms.marked_terms(state).withColumnRenamed("n_records", "n_chunks")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first three hits of each query's ranking."""
    hits = _hits(spark, folder)
    ranked = fusion.borda(*fusion.hit_scores(hits))
    return ranked.where("place <= 3").select(F.col("group").alias("query_id"), F.col("place").cast("int").alias("place"), F.col("item").alias("hit_id"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by key; a map can't be compared, so it travels as its sorted entries."""
    hits = table(spark, folder, "hits").withColumn("places", F.array_sort(F.map_entries("channels")))
    hits = latest(hits, ["hit_id"], "logged_at", ["query_id", "score", "places"])
    return hits.select("hit_id", "query_id", "score", F.map_from_entries("places").alias("channels"))


P1_SQL = """
WITH h AS (SELECT hit_id, max_by(file_id, logged_at) AS file_id, max_by(start_sec, logged_at) AS a, max_by(end_sec, logged_at) AS b
           FROM hits GROUP BY hit_id),
e AS (SELECT hit_id, 'start' AS edge, file_id, a AS t FROM h UNION ALL SELECT hit_id, 'end', file_id, b FROM h),
c AS (SELECT e.hit_id, e.edge, e.file_id, u.idx,
             abs(CAST(round(u.start_sec * 1000000) AS BIGINT) - CAST(round(e.t * 1000000) AS BIGINT)) AS d
      FROM e JOIN utterances u ON u.file_id = e.file_id AND u.start_sec BETWEEN e.t - 2.1 AND e.t + 2.1)
SELECT hit_id, edge, file_id, idx FROM c WHERE d <= 2000000
QUALIFY row_number() OVER (PARTITION BY hit_id, edge ORDER BY d, idx) = 1
"""

TOKENS_SQL = """regexp_extract_all(replace(regexp_replace(replace(lower({0}), '’', ''''), '''s\\b', '', 'g'), '''', ''), '[a-z0-9]+')"""

P4_PARTS = f"""
WITH c AS (SELECT id, max_by(text, ingested_at) AS text FROM chunks GROUP BY id),
t AS (SELECT id, unnest({TOKENS_SQL.format("text")}) AS term FROM c),
m AS (SELECT term, count(*) AS tj FROM t GROUP BY term),
s AS (SELECT CAST(sum(tj) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS v FROM m),
o AS (SELECT id, term, count(*) AS o, sum(count(*)) OVER (PARTITION BY id) AS ni FROM t GROUP BY id, term),
x AS (SELECT o.id, o.term, o, ni, n, (tj + 5.0) / (n + 5.0 * v) AS col FROM o JOIN m USING (term) CROSS JOIN s),
z AS (SELECT id, term, o, sign(o - ni * col) * greatest(abs(o - ni * col) - 0.5, 0) / sqrt(ni * col * (1 - ni / n) * (1 - col)) AS score FROM x)
"""

P4_SQL = f"""{P4_PARTS}
SELECT id AS chunk_id, term FROM z WHERE id IN (SELECT chunk_id FROM chunk_probes) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) = 1
"""

P4_SCORES_SQL = f"{P4_PARTS} SELECT id AS chunk_id, term, o AS observed, round(score, 4) AS score FROM z"

P6_SQL = f"""
WITH c AS (SELECT id, max_by(text, ingested_at) AS text FROM chunks GROUP BY id),
t AS (SELECT id, unnest({TOKENS_SQL.format("text")}) AS term FROM c),
n AS (SELECT count(*) AS n FROM c WHERE text <> '')
SELECT term, count(*) AS n_total, count(DISTINCT id) AS n_chunks,
       CASE WHEN count(DISTINCT id) <= 2 THEN 'rare' WHEN count(DISTINCT id) > 0.2 * any_value(n) THEN 'common' ELSE 'useful' END AS mark
FROM t CROSS JOIN n GROUP BY term
"""

P7_SQL = """
WITH h AS (SELECT hit_id, max_by(query_id, logged_at) AS q, max_by(score, logged_at) AS score, max_by(channels, logged_at) AS ch
           FROM hits GROUP BY hit_id),
names AS (SELECT DISTINCT unnest(map_keys(ch)) AS metric FROM h),
v AS (SELECT q, hit_id, 'score' AS metric, -score AS value FROM h
      UNION ALL SELECT q, hit_id, metric, CAST(ch[metric] AS DOUBLE) FROM h CROSS JOIN names),
r AS (SELECT q, hit_id, metric,
        CASE WHEN value IS NOT NULL
             THEN rank() OVER (PARTITION BY q, metric ORDER BY value NULLS LAST)
                  + (count(*) OVER (PARTITION BY q, metric, value) - 1) / 2.0
             ELSE (count(value) OVER (PARTITION BY q, metric) + 1 + count(*) OVER (PARTITION BY q, metric)) / 2.0 END AS rk FROM v)
SELECT q AS query_id, CAST(place AS INT) AS place, hit_id FROM (
  SELECT q, hit_id, row_number() OVER (PARTITION BY q ORDER BY round(sum(rk), 6), hit_id) AS place FROM r GROUP BY q, hit_id)
WHERE place <= 3
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_scores": p4_scores, "p6_found": p6_found, "p7_found": p7_found}
SQL = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p4_scores": P4_SCORES_SQL, "p6_found": P6_SQL, "p7_found": P7_SQL}
for _m in (queries_turns, queries_vectors, queries_sizes, queries_repetition):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL

