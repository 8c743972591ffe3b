"""Queries of the search channels, their fusion and the moments they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import queries as q
from earshot.functions import text as t
from earshot.functions.phonetics import sound_codes, stemmed
from earshot.operators import expansion, index, late, moments, search
from earshot.plans.published import published
from earshot.plans.sql import A, C, H, S, U, content, tok
from earshot.plans.text_queries import ASKS, DF, LEN, POST, QP, QT, STATS, STOP, VOCAB, passages
from earshot.session import cut, discard
from earshot.sources import catalog
from earshot.sources.tables import table


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text) of all queries, without role filters and quotation marks."""
    return catalog.queries(spark, folder).select("query_id", q.parsed(F.col("query_text"))["text"].alias("text"))


def _index(spark, folder):
    """Postings over plain tokens, lengths, frequencies and corpus statistics of the passages."""

    def build():
        p = passages(spark, folder)
        post = cut(index.postings(p), "postings")
        return {"postings": post, "lengths": index.doc_lengths(p, post), "frequencies": index.lexeme_frequencies(post)}

    ix = published(spark, "postings", folder, ("chunks",), build)
    return ix["postings"], ix["lengths"], ix["frequencies"], index.corpus_stats(ix["lengths"])


def bm25_topk(spark, folder):
    found = search.bm25(search.query_lexemes(asked(spark, folder)), *_index(spark, folder))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"), "rank")


def idf_map(spark, folder):
    words = search.query_lexemes(asked(spark, folder)).select("lexeme").distinct()
    _, _, df, stats = _index(spark, folder)
    rows = df.join(words, "lexeme", "left_semi").crossJoin(F.broadcast(stats))  # one row
    return rows.select("lexeme", "df", F.round(index.inverse_frequency(F.col("n"), F.col("df")), 6).alias("idf"))


def idf_coverage(spark, folder):
    """Coverage of the 50 best passages of each query."""
    lexemes = search.query_lexemes(asked(spark, folder))
    post, lengths, df, stats = _index(spark, folder)
    found = search.bm25(lexemes, post, lengths, df, stats)
    n = stats.first().n
    idf = df.select("lexeme", index.inverse_frequency(F.lit(n), F.col("df")).alias("idf"))
    matched = found.select("query_id", "id", F.explode("matched").alias("lexeme"))
    cov = search.coverage(lexemes.withColumn("unit", F.col("lexeme")), matched, idf, n)
    return cov.select("query_id", "id", F.round("coverage", 6).alias("coverage"))


def dense_topk(spark, folder):
    """Of every vector whose id is divisible by 100, the 50 nearest among all others."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ask = e.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = search.dense(ask, e, depth=51).where("query_id <> id")
    return search.best(found.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("id").asc()], 50)


def rrf_fusion(spark, folder):
    """The places of each hit in its channels, fused."""
    h = table(spark, folder, "hits").withColumn("places", F.array_sort(F.map_entries("channels")))
    h = h.groupBy("hit_id").agg(F.max(F.struct("logged_at", "query_id", "places")).alias("h")).select("hit_id", "h.query_id", F.explode("h.places").alias("p"))
    channels = h.select("query_id", F.col("p.key").alias("channel"), F.col("hit_id").alias("id"), F.col("p.value").alias("place"), F.lit(1.0).alias("multiplier"))
    fused = search.fuse(channels)
    named = F.array_join(F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    return fused.select("query_id", F.col("id").alias("hit_id"), F.round("score", 6).alias("score"), named.alias("channels"), "rank")


def phrase_filter(spark, folder):
    """(query_id, phrase, id): the passages with each quoted phrase, word by word."""
    rows = catalog.queries(spark, folder).select("query_id", F.explode(q.parsed(F.col("query_text"))["phrases"]).alias("phrase"))
    rows = rows.distinct().withColumn("pt", t.tokens(F.col("phrase"))).withColumn("first", F.get("pt", 0)).where("first is not null")
    p = passages(spark, folder).withColumn("toks", t.tokens(F.col("text"))).select("id", "toks", F.explode(F.array_distinct("toks")).alias("first"))
    return p.join(search.if_small(cut(rows, "phrases"), 1100), "first").where(search.contains_phrase(F.col("toks"), F.col("pt"))).select("query_id", "phrase", "id")


def role_semi_join(spark, folder):
    c = catalog.chunks(spark, folder, "file_id", "speakers")
    return search.with_role(c, catalog.speakers(spark, folder), "guest").select("id", "file_id")


def allowed_labels(spark, folder):
    """The utterances whose speaker, by label, is a host of the recording."""
    u = catalog.utterances(spark, folder, "speaker")
    s = catalog.speakers(spark, folder).where("role = 'host'").select("file_id", F.col("label").alias("speaker"))
    return u.join(s, ["file_id", "speaker"], "left_semi").select("file_id", "idx")


def utterance_range_join(spark, folder):
    c = catalog.chunks(spark, folder, "file_id", "utt_start", "utt_end")
    rows = search.passage_utterances(c, catalog.utterances(spark, folder, "start_sec"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def distinct_on(spark, folder):
    """Utterances that lie in some passage, once each."""
    c = catalog.chunks(spark, folder, "file_id", "utt_start", "utt_end")
    rows = search.passage_utterances(c, catalog.utterances(spark, folder, "start_sec")).dropDuplicates(["file_id", "idx"])
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("start_sec"), 3).alias("sum_start"))


def array_intersect_matched(spark, folder):
    h = catalog.hits(spark, folder, "query_id", "text").join(asked(spark, folder).withColumnRenamed("text", "ask"), "query_id")
    both = F.array_sort(F.array_intersect(t.tokens(F.col("text")), t.tokens(F.col("ask"))))
    return h.select("hit_id", F.coalesce(F.array_join(both, " "), F.lit("")).alias("matched"))


def query_words(spark, folder):
    """The content words of all queries, and each once more as a typist who misses its third letter would write it."""
    words = asked(spark, folder).select(F.explode(t.content_tokens(t.tokens(F.col("text")))).alias("w"))
    typo = F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)"))
    return words.select(F.explode(F.array(F.col("w"), typo)).alias("tok")).distinct()


def lexicon(spark, folder):
    """Common words: those of at least 20 English documents."""
    d = table(spark, folder, "documents").where("lang = 'en'").select(F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("term"))
    return d.groupBy("term").count().where("count >= 20").select("term")


def vocab_anti_join(spark, folder):
    v = index.vocabulary(passages(spark, folder)).select(F.col("term").alias("tok"))
    return query_words(spark, folder).join(v, "tok", "left_anti")


def expansion_policy(spark, folder):
    return expansion.policies(query_words(spark, folder), index.vocabulary(passages(spark, folder)), lexicon(spark, folder))


def _spelling(spark, folder):
    none = {c: F.lit(None).cast("string") for c in ("metaphone", "dmetaphone", "dmetaphone_alt")}
    policy = cut(expansion_policy(spark, folder), "policy")
    words, vocab = policy.select("tok").withColumns(none), cut(index.vocabulary(passages(spark, folder)).withColumns(none), "vocabulary")
    near = expansion.neighbours(words, vocab).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("mph", "dm")})
    return policy, near


def vocab_fuzzy_join(spark, folder):
    """Spoken words near each query word in spelling."""
    _, near = _spelling(spark, folder)
    return near.select("tok", "term", F.round("trgm", 6).alias("trgm"), "lev")


def expansion_spelling_top3(spark, folder):
    policy, near = _spelling(spark, folder)
    return expansion.expansions(near, policy)


def expansion_top3(spark, folder):
    """With sound codes too."""
    policy = cut(expansion_policy(spark, folder), "policy")
    coded = lambda df, c: df.select("*", F.inline(F.array(sound_codes(F.col(c)))))
    near = expansion.neighbours(coded(policy.select("tok"), "tok"), cut(coded(index.vocabulary(passages(spark, folder)), "term"), "vocabulary"))
    return expansion.expansions(near, policy)


def snap_best_sentence(spark, folder):
    """The best sentence of the three best passages of each query, by its words and by how near its vector is to the passage's."""
    lexemes = search.query_lexemes(asked(spark, folder))
    post, lengths, df, stats = _index(spark, folder)
    found = cut(search.bm25(lexemes, post, lengths, df, stats, depth=3, matched=False).select("query_id", "id"), "found")
    c = catalog.chunks(spark, folder, "file_id", "utt_start", "utt_end", "embedding").join(found.select("id").distinct(), "id", "left_semi")
    u = cut(search.passage_utterances(c.drop("embedding"), catalog.utterances(spark, folder, "text", "embedding")), "sentences")
    sem = u.join(c.select("id", F.col("embedding").alias("whole")), "id").select("id", "idx", F.round(search.paired_cosine(F.col("embedding"), F.col("whole")), 9).alias("sem"))
    words = u.select("id", "file_id", "idx", "text", F.explode_outer(F.array_distinct(t.tokens(F.coalesce("text", F.lit(""))))).alias("lexeme"))
    mass = lexemes.join(df.crossJoin(F.broadcast(stats)), "lexeme").select("query_id", "lexeme", index.inverse_frequency(F.col("n"), F.col("df")).alias("idf"))
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n_words")
    lex = words.join(found, "id").join(mass, ["query_id", "lexeme"], "left").groupBy("query_id", "id", "file_id", "idx", n_words).agg(F.sum("idf").alias("lex"))
    rows = lex.join(sem, ["id", "idx"], "left").join(q_intent(spark, folder), "query_id")
    best = moments.snap(rows, lex_w=moments.lexical_weight(F.lit("hybrid"), F.col("intent")))
    return best.select("query_id", "id", "file_id", "idx", F.round("snap_score", 6).alias("score"))


def q_intent(spark, folder):
    p = catalog.queries(spark, folder).select("query_id", *[c.alias(n) for n, c in q.parsed(F.col("query_text")).items()])
    return p.select("query_id", q.intent(F.col("text"), F.col("phrases"), F.col("toks"), F.col("content")).alias("intent"))


def hybrid_topk(spark, folder):
    """The probe passages as queries, by their words and by their vectors: both channels fused, the first ten others of each."""
    probes = table(spark, folder, "chunk_probes").select(F.col("chunk_id").alias("query_id")).distinct()
    c = cut(catalog.chunks(spark, folder, "text", "embedding"), "passages")
    mine = c.withColumnRenamed("id", "query_id").join(probes, "query_id", "left_semi")
    post, lengths, df, stats = _index(spark, folder)
    words = search.bm25(search.query_lexemes(mine), post, lengths, df, stats, matched=False)
    near = search.dense(mine.select("query_id", F.col("embedding").alias("vector")), c.select("id", F.col("embedding").alias("vector")))
    place = lambda d, name: d.select("query_id", F.lit(name).alias("channel"), "id", F.col("rank").alias("place"), F.lit(1.0).alias("multiplier"))
    fused = search.fuse(place(words, "lexical").unionByName(place(near, "dense"))).where("query_id <> id").drop("rank")
    named = F.array_join(F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    best = search.best(fused, ["query_id"], [F.col("score").desc(), F.array_min(F.map_values("channels")).asc(), F.col("id").asc()], 10)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), named.alias("channels"), "rank")


def temporal_nms(spark, folder):
    """The hits of each query that are not too near a better one."""
    h = catalog.hits(spark, folder, "query_id", "rank", "file_id", "start_sec", "end_sec").where("start_sec is not null and end_sec is not null")
    rows = h.select("*", F.lit(None).cast("int").alias("idx"), F.col("start_sec").alias("p_start"), F.col("end_sec").alias("p_end"))
    return moments.distinct_moments(rows.withColumn("idx", F.col("hit_id"))).select("query_id", "rank", "hit_id")


def hydrated_hits(spark, folder):
    h = catalog.hits(spark, folder, "file_id", "speaker")
    return moments.complete_hits(h, catalog.audio_files(spark, folder, "title"), catalog.speakers(spark, folder)).select("hit_id", "title", "role", "name")


def maxsim(spark, folder):
    """Pairs of vectors as queries (every hundredth id and the next), groups of four as passages."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    some = e.where("vec_id % 100 in (0, 1)").groupBy((F.col("vec_id") - F.col("vec_id") % 100).alias("id"))
    sorted_ = lambda: F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors")
    left = some.agg(sorted_())
    right = e.groupBy(F.floor(F.col("vec_id") / 4).alias("id")).agg(sorted_())
    pairs = right.select(F.col("id").alias("r")).crossJoin(search.if_small(cut(left.select(F.col("id").alias("l")), "asked"), 8))
    return late.maxsim(left, right, pairs)


def rerank_split(spark, folder):
    """Hits judged by their score against the best of the query, those found first everywhere being sure; then ordered."""
    h = catalog.hits(spark, folder, "query_id", "rank", "score").where("score is not null")
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("query_id"))
    rows = h.withColumn("rerank", F.try_divide("score", top)).withColumn("coverage", F.when(F.col("rank") == 1, 1.0).otherwise(0.0))
    rows = rows.withColumn("late", F.round(F.sin(F.col("hit_id").cast("double")), 6)).withColumn("fused_rank", F.col("rank"))
    rows = search.best(moments.split_sure(rows), ["query_id"], [*moments.final_order(), F.col("hit_id").asc()], None, "place")
    return rows.select("query_id", "hit_id", "related", "place")


def half_precision(spark, folder):
    """Token vectors kept as half-precision bytes come back near to what they were."""
    e = table(spark, folder, "embeddings").select("vec_id", F.array("embedding").alias("m"))
    back = e.select("vec_id", "m", late.unpack_half(late.pack_half(F.col("m")), 64).alias("b"))
    off = F.aggregate(F.zip_with(F.get("m", 0), F.get("b", 0), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return back.select("vec_id", (off < 0.001).alias("near"))


def stemmed_bm25(spark, folder):
    """Keyword search over stems, each worked out once per distinct word."""
    p = passages(spark, folder)
    words = index.postings(p)
    words = cut(words, "words")
    stems = cut(words.select("lexeme").distinct().where(~F.col("lexeme").isin(t.STOP_WORDS)).select("lexeme", stemmed(F.col("lexeme")).alias("stem")), "stems")
    post = words.join(stems, "lexeme").groupBy("id", F.col("stem").alias("lexeme")).agg(F.sum("tf").alias("tf"))
    post = cut(post, "postings")
    discard(words)
    lengths = cut(index.doc_lengths(p, post), "lengths")
    ask = search.query_lexemes(asked(spark, folder)).where(~F.col("lexeme").isin(t.STOP_WORDS))
    ask = ask.select("query_id", stemmed(F.col("lexeme")).alias("lexeme"), "w").groupBy("query_id", "lexeme").agg(F.sum("w").alias("w"))
    found = search.bm25(ask, post, lengths, index.lexeme_frequencies(post), index.corpus_stats(lengths), matched=False)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


QQ = f"qq AS (SELECT query_id, {QT} AS text FROM queries)"
QL = f"ql AS (SELECT query_id, lexeme, CAST(count(*) AS DOUBLE) AS w FROM (SELECT query_id, unnest({tok('text')}) AS lexeme FROM qq) GROUP BY query_id, lexeme)"
IDF = "idf AS (SELECT lexeme, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM d CROSS JOIN st)"
BASE = ", ".join([C, POST, LEN, DF, STATS, QQ, QL, IDF])
BM = """b AS (SELECT query_id, p.id, round(sum(w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score, list_sort(list(lexeme)) AS matched
          FROM ql JOIN idf USING (lexeme) JOIN p USING (lexeme) JOIN dl ON dl.id = p.id CROSS JOIN st GROUP BY query_id, p.id),
        bk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""
QW = f"q0 AS (SELECT unnest({content(tok('text'), STOP)}) AS w FROM qq), qw AS (SELECT w AS tok FROM q0 UNION SELECT left(w, 2) || substr(w, 4) FROM q0)"
LEX = f"lx AS (SELECT term FROM (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents WHERE lang = 'en') GROUP BY term HAVING count(*) >= 20)"
POL = """pol AS (SELECT tok, CASE WHEN v.term IS NULL THEN CASE WHEN lx.term IS NULL THEN 'open' ELSE 'strict' END
                              WHEN v.df <= 2 AND lx.term IS NULL THEN 'strict' END AS policy
           FROM qw LEFT JOIN v ON v.term = tok LEFT JOIN lx ON lx.term = tok
           WHERE len(tok) >= 4 AND regexp_full_match(tok, '[a-z]+'))"""
TG = "list_distinct(list_transform(range(0, len({0}) + 1), lambda i: substr('  ' || {0} || ' ', CAST(i + 1 AS BIGINT), 3)))"
NEAR = f"""nt AS (SELECT tok, {TG.format("tok")} AS qg FROM pol WHERE policy IS NOT NULL), nv AS (SELECT term, {TG.format("term")} AS vg FROM v),
        near AS (SELECT tok, term, len(list_intersect(qg, vg)) / len(list_distinct(list_concat(qg, vg))) AS trgm, levenshtein(term, tok) AS lev
                 FROM nt JOIN nv ON tok <> term),
        fz AS (SELECT * FROM near WHERE trgm >= 0.3 OR (len(tok) >= 5 AND contains(term, left(tok, len(tok) - 1))))"""
#: The cosine of two vectors, null where there is none.
COS = """CASE WHEN len({0}) = len({1}) AND list_sum(list_transform({0}, lambda x: x * x)) > 0 AND list_sum(list_transform({1}, lambda x: x * x)) > 0
         THEN list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) * list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))) END"""
WORDS = ", ".join([C, VOCAB, QQ, QW, LEX, POL])

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, idf_map, idf_coverage, dense_topk, rrf_fusion, phrase_filter, role_semi_join, allowed_labels, utterance_range_join, distinct_on,
        array_intersect_matched, vocab_anti_join, expansion_policy, vocab_fuzzy_join, expansion_spelling_top3, expansion_top3, snap_best_sentence,
        temporal_nms, hydrated_hits, hybrid_topk, maxsim, rerank_split, half_precision, stemmed_bm25,
    )
}
SQL = {
    "bm25_topk": f"WITH {BASE}, {BM} SELECT query_id, id, round(score, 6) AS score, array_to_string(matched, ' ') AS matched, CAST(rank AS INT) AS rank FROM bk WHERE rank <= 50",
    "idf_map": f"WITH {BASE} SELECT lexeme, df, round(idf, 6) AS idf FROM idf WHERE lexeme IN (SELECT lexeme FROM ql)",
    "idf_coverage": f"""WITH {BASE}, {BM},
        un AS (SELECT query_id, ql.lexeme, coalesce(idf, ln(1 + (st.n + 0.5) / 0.5)) AS mass FROM ql LEFT JOIN idf USING (lexeme) CROSS JOIN st),
        tt AS (SELECT query_id, sum(mass) AS total FROM un GROUP BY query_id),
        g AS (SELECT m.query_id, m.id, sum(mass) AS got FROM (SELECT query_id, id, unnest(matched) AS lexeme FROM bk WHERE rank <= 50) m
              JOIN un ON un.query_id = m.query_id AND un.lexeme = m.lexeme GROUP BY m.query_id, m.id)
        SELECT query_id, id, round(got / total, 6) AS coverage FROM g JOIN tt USING (query_id)""",
    "dense_topk": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        x AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
              FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id)
        SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM x QUALIFY rank <= 50""",
    "rrf_fusion": f"""WITH {H}, x AS (SELECT query_id, hit_id, unnest(map_entries(channels)) AS e FROM h),
        f AS (SELECT query_id, hit_id, round(sum(1.0::DOUBLE / (10 + e.value)), 9) AS score, min(e.value) AS bp,
                     string_agg(e.key || ':' || e.value, ' ' ORDER BY e.key) AS channels FROM x GROUP BY query_id, hit_id)
        SELECT query_id, hit_id, round(score, 6) AS score, channels,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bp, hit_id) AS INT) AS rank FROM f""",
    "phrase_filter": f"""WITH {C}, x AS (SELECT DISTINCT query_id, unnest({QP}) AS phrase FROM queries),
        y AS (SELECT query_id, phrase, ' ' || array_to_string({tok("phrase")}, ' ') || ' ' AS p FROM x), z AS (SELECT id, ' ' || array_to_string({tok("text")}, ' ') || ' ' AS t FROM c)
        SELECT query_id, phrase, id FROM y JOIN z ON len(trim(p)) > 0 AND contains(t, p)""",
    "role_semi_join": f"WITH {C}, {S} SELECT id, file_id FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.file_id = c.file_id AND role = 'guest' AND list_contains(c.speakers, label))",
    "allowed_labels": f"WITH {U}, {S} SELECT file_id, idx FROM u WHERE EXISTS (SELECT 1 FROM s WHERE s.file_id = u.file_id AND role = 'host' AND label = u.speaker)",
    "utterance_range_join": f"""WITH {C}, {U} SELECT c.id, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
        FROM c JOIN u ON u.file_id = c.file_id AND idx >= utt_start AND idx < utt_end GROUP BY c.id""",
    "distinct_on": f"""WITH {C}, {U}, x AS (SELECT DISTINCT ON (u.file_id, idx) u.file_id, idx, u.start_sec FROM c JOIN u ON u.file_id = c.file_id AND idx >= utt_start AND idx < utt_end)
        SELECT file_id, count(*) AS n, round(sum(start_sec), 3) AS sum_start FROM x GROUP BY file_id""",
    "array_intersect_matched": f"""WITH {H}, {QQ} SELECT hit_id, coalesce(array_to_string(list_sort(list_intersect(list_distinct({tok("h.text")}), list_distinct({tok("qq.text")}))), ' '), '') AS matched FROM h JOIN qq USING (query_id)""",
    "vocab_anti_join": f"WITH {C}, {VOCAB}, {QQ}, {QW} SELECT tok FROM qw WHERE tok NOT IN (SELECT term FROM v)",
    "expansion_policy": f"WITH {WORDS} SELECT tok, policy FROM pol WHERE policy IS NOT NULL",
    "vocab_fuzzy_join": f"WITH {WORDS}, {NEAR} SELECT tok, term, round(trgm, 6) AS trgm, CAST(lev AS INT) AS lev FROM fz",
    "expansion_spelling_top3": f"""WITH {WORDS}, {NEAR},
        o AS (SELECT fz.tok, term, greatest(trgm, 1 - lev / greatest(len(fz.tok), len(term))) AS o1,
                     len(fz.tok) >= 5 AND (SELECT bool_or(contains(term, substr(fz.tok, CAST(i + 1 AS BIGINT), CAST(ceil(0.85 * len(fz.tok)) AS BIGINT))))
                       FROM (SELECT unnest(range(0, CAST(len(fz.tok) - ceil(0.85 * len(fz.tok)) + 1 AS BIGINT))) AS i)) AS part
              FROM fz JOIN pol ON pol.tok = fz.tok AND policy = 'open'),
        s3 AS (SELECT tok, term, CASE WHEN part THEN greatest(o1, 0.7) ELSE o1 END AS exact FROM o)
        SELECT tok, term, round(exact, 3) AS score, CAST(row_number() OVER (PARTITION BY tok ORDER BY round(exact, 3) DESC, term) AS INT) AS place
        FROM s3 WHERE exact >= 0.62 QUALIFY place <= 3""",
    "snap_best_sentence": f"""WITH {BASE}, {BM}, {U},
        k AS (SELECT query_id, id FROM bk WHERE rank <= 3),
        x AS (SELECT k.query_id, k.id, u.file_id, u.idx, list_distinct({tok("coalesce(u.text, '')")}) AS toks, len(list_filter(string_split(coalesce(u.text, ''), ' '), lambda w: w <> '')) AS n_words,
                     {COS.format("u.embedding", "c.embedding")} AS sem
              FROM k JOIN c USING (id) JOIN u ON u.file_id = c.file_id AND u.idx >= utt_start AND u.idx < utt_end),
        y AS (SELECT x.query_id, x.id, x.file_id, x.idx, n_words, coalesce(round(sem, 9), 0) AS sem, coalesce(sum(idf), 0) AS lex FROM x
              LEFT JOIN (SELECT ql.query_id, ql.lexeme, idf FROM ql JOIN idf USING (lexeme)) m ON m.query_id = x.query_id AND list_contains(x.toks, m.lexeme)
              GROUP BY x.query_id, x.id, x.file_id, x.idx, n_words, sem),
        i AS (SELECT query_id, {QT} AS text, {QP} AS ph FROM queries), j AS (SELECT *, {tok("text")} AS toks FROM i), kind AS (SELECT query_id,
              CASE WHEN len(ph) > 0 THEN 0.8 WHEN ends_with(text, '?') OR coalesce(list_contains({ASKS}, toks[1]), false) THEN 0.5
                   WHEN len({content("toks", STOP)}) <= 2 AND len(toks) <= 3 THEN 0.8 ELSE 0.5 END AS lw FROM j),
        z AS (SELECT *, max(lex) OVER (PARTITION BY query_id, id) AS top, min(sem) OVER (PARTITION BY query_id, id) AS lo, max(sem) OVER (PARTITION BY query_id, id) AS hi FROM y),
        n AS (SELECT *, CASE WHEN top > 0 THEN lex / top ELSE 0 END AS ln_, CASE WHEN hi > lo THEN (sem - lo) / (hi - lo) * (CASE WHEN n_words < 4 THEN 0.5 ELSE 1 END) ELSE 0 END AS sn FROM z),
        w AS (SELECT n.*, round(CASE WHEN top > 0 THEN lw * ln_ + (1 - lw) * sn ELSE sn END, 9) AS score FROM n JOIN kind USING (query_id))
        SELECT query_id, id, file_id, idx, round(score, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, idx) = 1""",
    "temporal_nms": f"""WITH RECURSIVE {H}, o AS (SELECT query_id, rank, hit_id, file_id AS f, start_sec AS a, end_sec AS b, row_number() OVER (PARTITION BY query_id ORDER BY rank, hit_id) AS r
              FROM h WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
        s AS (SELECT query_id, r, [{{'rank': rank, 'hit_id': hit_id, 'f': f, 'a': a, 'b': b}}] AS kept FROM o WHERE r = 1
              UNION ALL SELECT o.query_id, o.r, CASE WHEN len(list_filter(kept, lambda k: k.f = o.f AND (abs(k.a - o.a) < 10
                    OR greatest(0, least(k.b, o.b) - greatest(k.a, o.a)) / greatest(least(k.b - k.a, o.b - o.a), 1e-6) > 0.5))) > 0 THEN kept
                    ELSE list_append(kept, {{'rank': o.rank, 'hit_id': o.hit_id, 'f': o.f, 'a': o.a, 'b': o.b}}) END
              FROM s JOIN o ON o.query_id = s.query_id AND o.r = s.r + 1),
        e AS (SELECT query_id, unnest(kept) AS k FROM (SELECT * FROM s QUALIFY r = max(r) OVER (PARTITION BY query_id)))
        SELECT query_id, k.rank AS rank, k.hit_id AS hit_id FROM e""",
    "hybrid_topk": f"""WITH {", ".join([C, POST, LEN, DF, STATS])}, m AS (SELECT * FROM c WHERE id IN (SELECT chunk_id FROM chunk_probes)),
        ql AS (SELECT query_id, lexeme, CAST(count(*) AS DOUBLE) AS w FROM (SELECT id AS query_id, unnest({tok("text")}) AS lexeme FROM m) GROUP BY query_id, lexeme), {IDF}, {BM},
        nd AS (SELECT m.id AS query_id, c.id, round({COS.format("m.embedding", "c.embedding")}, 6) AS s FROM m JOIN c ON {COS.format("m.embedding", "c.embedding")} IS NOT NULL),
        ch AS (SELECT query_id, id, 'lexical' AS ch, rank AS pl FROM bk WHERE rank <= 50
               UNION ALL SELECT query_id, id, 'dense', row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS pl FROM nd QUALIFY pl <= 50),
        f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (10 + pl)), 9) AS score, min(pl) AS bp, string_agg(ch || ':' || pl, ' ' ORDER BY ch) AS channels FROM ch GROUP BY query_id, id)
        SELECT query_id, id, round(score, 6) AS score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bp, id) AS INT) AS rank FROM f WHERE query_id <> id QUALIFY rank <= 10""",
    "hydrated_hits": f"""WITH {H}, {A}, {S} SELECT hit_id, coalesce(a.title, h.file_id) AS title, coalesce(s.role, 'unknown') AS role, s.name
        FROM h LEFT JOIN a ON a.file_id = h.file_id LEFT JOIN s ON s.file_id = h.file_id AND s.label = h.speaker""",
    "maxsim": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        m AS (SELECT a.vec_id - a.vec_id % 100 AS l, a.vec_id, b.vec_id // 4 AS r, max(list_dot_product(a.v, b.v)) AS best FROM e a JOIN e b ON a.vec_id % 100 IN (0, 1) GROUP BY ALL)
        SELECT l, r, round(sum(best), 6) AS score FROM m GROUP BY l, r""",
    "rerank_split": f"""WITH {H}, x AS (SELECT *, score / nullif(max(score) OVER (PARTITION BY query_id), 0) AS rr FROM h WHERE score IS NOT NULL),
        y AS (SELECT *, NOT (coalesce(rr, 0) >= 0.83 OR rank = 1) AS rel, round(sin(hit_id), 6) AS late FROM x)
        SELECT query_id, hit_id, rel AS related, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rel, CASE WHEN NOT rel THEN rr END DESC NULLS LAST,
               CASE WHEN rel THEN late END DESC NULLS LAST, rank, hit_id) AS INT) AS place FROM y""",
    "half_precision": "SELECT vec_id, true AS near FROM embeddings",
}
