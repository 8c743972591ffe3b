"""Queries over texts and the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import queries as q
from earshot.functions import text as t
from earshot.functions.phonetics import sound_codes, stemmed
from earshot.operators import index
from earshot.plans.sql import A, C, H, U, content, stop_list, tok
from earshot.sources import catalog

STOP = stop_list(t.STOP_WORDS)
ABBR = stop_list(t.ABBREVIATIONS)


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.chunks(spark, folder, "text")


def tokenize(spark, folder):
    return passages(spark, folder).select("id", F.array_join(t.tokens(F.col("text")), " ").alias("tokens"))


def content_tokens(spark, folder):
    return passages(spark, folder).select("id", F.array_join(t.content_tokens(t.tokens(F.col("text"))), " ").alias("tokens"))


def postings_tf(spark, folder):
    return index.postings(passages(spark, folder))


def doc_len(spark, folder):
    p = passages(spark, folder)
    return index.doc_lengths(p, index.postings(p))


def lexeme_df(spark, folder):
    return index.lexeme_frequencies(index.postings(passages(spark, folder)))


def corpus_stats(spark, folder):
    return index.corpus_stats(doc_len(spark, folder)).select("n", F.round("avg_len", 6).alias("avg_len"))


def vocabulary_df(spark, folder):
    return index.vocabulary(passages(spark, folder))


def intent_classify(spark, folder):
    p = q.parsed(F.col("query_text"), F.col("role"))
    rows = catalog.queries(spark, folder).select("query_id", *[c.alias(n) for n, c in p.items()])
    kind = q.intent(F.col("text"), F.col("phrases"), F.col("toks"), F.col("content"))
    return rows.select("query_id", "text", F.array_join("phrases", "|").alias("phrases"), "role", kind.alias("intent"))


def mmss(spark, folder):
    return catalog.hits(spark, folder, "start_sec").select("hit_id", t.minutes(F.col("start_sec")).alias("timestamp"))


def sentence_ends(spark, folder):
    u = catalog.utterances(spark, folder, "text")
    word = F.element_at(F.split("text", " "), -1)
    return u.select("file_id", "idx", t.is_question(F.col("text")).alias("question"), t.ends_sentence(word).alias("ends"))


def file_slugs(spark, folder):
    name = F.concat("title", F.lit(".Final Cut.MP3"))
    return catalog.audio_files(spark, folder, "title").select("file_id", t.file_slug(name).alias("slug"))


def quotes(spark, folder):
    return passages(spark, folder).select("id", t.quote(F.col("text")).alias("quote"))


def passage_overlap(spark, folder):
    c = catalog.chunks(spark, folder, "file_id", "start_sec", "end_sec")
    a, b = c.alias("a"), c.alias("b")
    # neighbours by number within the recording, so the join has equal keys
    recording = lambda x: F.regexp_extract(f"{x}.id", r"^(.*_c)\d+$", 1)
    number = lambda x: F.regexp_extract(f"{x}.id", r"(\d+)$", 1).cast("int")
    rows = a.join(b, (recording("a") == recording("b")) & (number("a") + 1 == number("b")))
    shared = t.overlap(F.col("a.start_sec"), F.col("a.end_sec"), F.col("b.start_sec"), F.col("b.end_sec"))
    return rows.select(F.col("a.id").alias("id"), F.col("b.id").alias("next_id"), F.round(shared, 6).alias("shared"))


def vocabulary_codes(spark, folder):
    """The vocabulary with its sound codes and stems, worked out once per distinct word."""
    v = index.vocabulary(passages(spark, folder)).repartition(F.col("term"))
    return v.select("term", "df", F.inline(F.array(sound_codes(F.col("term")))), ).join(v.select("term", stemmed(F.col("term")).alias("stem")), "term")


T = tok("text")
QT = r"trim(regexp_replace(replace(regexp_replace(coalesce(query_text, ''), '\brole:(host|guest)\b', ' ', 'gi'), '\"', ' '), '\s+', ' ', 'g'))".replace('\\"', '"')
QR = r"coalesce(role, nullif(lower(regexp_extract(coalesce(query_text, ''), '\brole:(host|guest)\b', 1, 'i')), ''))"
QP = r"""list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(query_text, ''), '\brole:(host|guest)\b', ' ', 'gi'), '"([^"]{1,200})"', 1), lambda x: trim(x)), lambda x: x <> '')"""
ASKS = "[" + ", ".join(f"'{w}'" for w in q.QUESTION_WORDS) + "]"
POST = f"p AS (SELECT id, term AS lexeme, count(*) AS tf FROM (SELECT id, unnest({T}) AS term FROM c) GROUP BY id, term)"
LEN = "dl AS (SELECT c.id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS doc_len FROM c LEFT JOIN p ON c.id = p.id GROUP BY c.id)"
DF = "d AS (SELECT lexeme, count(*) AS df FROM p GROUP BY lexeme)"
STATS = "st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(doc_len) AS avg_len FROM dl)"
VOCAB = f"v AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct({content(T, STOP)})) AS term FROM c) GROUP BY term)"

QUERIES = {
    f.__name__: f
    for f in (tokenize, content_tokens, postings_tf, doc_len, lexeme_df, corpus_stats, vocabulary_df, intent_classify, mmss, sentence_ends, file_slugs, quotes, passage_overlap, vocabulary_codes)
}
SQL = {
    "tokenize": f"WITH {C} SELECT id, array_to_string({T}, ' ') AS tokens FROM c",
    "content_tokens": f"WITH {C} SELECT id, array_to_string({content(T, STOP)}, ' ') AS tokens FROM c",
    "postings_tf": f"WITH {C}, {POST} SELECT id, lexeme, tf FROM p",
    "doc_len": f"WITH {C}, {POST}, {LEN} SELECT id, doc_len FROM dl",
    "lexeme_df": f"WITH {C}, {POST}, {DF} SELECT lexeme, df FROM d",
    "corpus_stats": f"WITH {C}, {POST}, {LEN}, {STATS} SELECT n, round(avg_len, 6) AS avg_len FROM st",
    "vocabulary_df": f"WITH {C}, {VOCAB} SELECT term, df FROM v",
    "intent_classify": f"""WITH x AS (SELECT query_id, {QT} AS text, {QP} AS ph, {QR} AS role FROM queries),
        y AS (SELECT *, {tok("text")} AS toks FROM x), z AS (SELECT *, {content("toks", STOP)} AS con FROM y)
        SELECT query_id, text, coalesce(array_to_string(ph, '|'), '') AS phrases, role,
          CASE WHEN len(ph) > 0 THEN 'phrase' WHEN ends_with(text, '?') OR coalesce(list_contains({ASKS}, toks[1]), false) THEN 'question'
               WHEN len(con) <= 2 AND len(toks) <= 3 THEN 'keyword' ELSE 'topic' END AS intent FROM z""",
    "mmss": f"""WITH {H}, x AS (SELECT hit_id, round(start_sec, 1) AS t FROM h)
        SELECT hit_id, CASE WHEN t IS NOT NULL THEN printf('%02d:%04.1f', CAST(floor(t / 60) AS INT), t - floor(t / 60) * 60) END AS timestamp FROM x""",
    "sentence_ends": f"""WITH {U}, x AS (SELECT file_id, idx, text, string_split(text, ' ')[-1] AS w FROM u)
        SELECT file_id, idx, coalesce(ends_with(rtrim(text), '?'), false) AS question,
          coalesce(NOT (list_contains({ABBR}, lower(w)) OR regexp_full_match(lower(w), '([a-z]\\.){{2,}}')) AND regexp_matches(w, '[.?!]["'')\\]]*$'), false) AS ends FROM x""",
    "file_slugs": f"""WITH {A}, x AS (SELECT file_id, left(trim(regexp_replace(lower(regexp_replace(regexp_replace(title || '.Final Cut.MP3', '^.*/', ''), '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_'), 48) AS s FROM a)
        SELECT file_id, CASE WHEN s = '' THEN 'recording' ELSE s END AS slug FROM x""",
    "quotes": f"WITH {C} SELECT id, CASE WHEN len(text) > 240 THEN left(text, 237) || '...' ELSE text END AS quote FROM c",
    "passage_overlap": f"""WITH {C}, x AS (SELECT *, regexp_extract(id, '^(.*_c)\\d+$', 1) AS f, CAST(regexp_extract(id, '(\\d+)$', 1) AS INT) AS n FROM c)
        SELECT a.id, b.id AS next_id,
          round(greatest(0, least(a.end_sec, b.end_sec) - greatest(a.start_sec, b.start_sec)) / greatest(least(a.end_sec - a.start_sec, b.end_sec - b.start_sec), 1e-6), 6) AS shared
        FROM x a JOIN x b ON a.f = b.f AND b.n = a.n + 1""",
}
