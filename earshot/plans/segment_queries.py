"""Queries over timed words, segments and speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.operators import diarization, segments
from earshot.plans import ingest
from earshot.functions.text import ABBREVIATIONS
from earshot.plans.sql import A, U, stop_list
from earshot.session import owned
from earshot.sources import catalog, html, transcripts

#: A recording's words are numbered by utterance and place.
PER_UTTERANCE = 10_000


def spoken_words(spark: SparkSession, folder: str) -> DataFrame:
    u = catalog.utterances(spark, folder, "speaker", "words")
    rows = u.select("file_id", F.col("idx").alias("i"), "speaker", F.posexplode("words").alias("n", "w"))
    return rows.select(
        "file_id", (F.col("i").cast("long") * PER_UTTERANCE + F.col("n")).alias("idx"), F.coalesce("speaker", F.lit("")).alias("speaker"),
        F.col("w.tok").alias("text"), F.col("w.start_sec").alias("start_sec"), F.col("w.end_sec").alias("end_sec"),
    )


def monotone_start(spark, folder):
    rows = segments.monotone(spoken_words(spark, folder))
    return rows.select("file_id", "idx", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def turn_boundaries(spark, folder):
    w = spoken_words(spark, folder)
    ends = w.groupBy("file_id", F.floor(F.col("idx") / PER_UTTERANCE).alias("seg")).agg(F.max("idx").alias("idx"))
    return segments.boundaries(w, ends).select("file_id", "idx", "boundary")


def speech_regions(spark, folder):
    rows = segments.speech_regions(spoken_words(spark, folder))
    return rows.select("file_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def sliding_windows(spark, folder):
    rows = segments.sliding_windows(segments.speech_regions(spoken_words(spark, folder)))
    return rows.select("file_id", "n", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def turn_merge(spark, folder):
    rows = segments.merged_turns(catalog.utterances(spark, folder, "speaker", "text"))
    return rows.select("file_id", F.col("turn").cast("long").alias("turn"), "speaker", "first_idx", "last_idx", "text")


def first_speaker(spark, folder):
    u = catalog.utterances(spark, folder, "speaker").withColumn("path", F.coalesce("speaker", F.lit("")))
    return segments.first_speaker(u).select("file_id", "idx", "label")


def segment_ends(spark, folder):
    """The last word before each utterance's end, utterances taken as segments."""
    segs = catalog.utterances(spark, folder, "end_sec").where("end_sec is not null").select("file_id", F.col("idx").alias("seg"), "end_sec")
    ends = spoken_words(spark, folder).withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("start_sec", "idx")))
    return segments.segment_ends(ends, segs).select("file_id", "seg", F.col("idx").cast("int").alias("idx"))


def passages(spark, folder):
    p = segments.passages(catalog.utterances(spark, folder, "start_sec", "end_sec", "speaker", "text"))
    return p.select("id", "file_id", "utt_start", "utt_end", "start_sec", "end_sec", F.array_join("speakers", "|").alias("speakers"), "text")


def utterances_of_words(spark, folder):
    """Utterances cut anew from the words."""
    rows = segments.build_utterances(spoken_words(spark, folder))
    return rows.select("file_id", "idx", "speaker", "start_sec", "end_sec", "text")


def roles_score(spark, folder):
    rows = segments.roles(catalog.utterances(spark, folder, "speaker", "text").where("speaker is not null"))
    return rows.select("file_id", "label", "role", "confidence", "n_words", "question_rate")


def _windows(spark, folder):
    w = segments.sliding_windows(segments.speech_regions(spoken_words(spark, folder)))
    p = 0.5 + 0.4 * F.sin(F.col("n").cast("double"))
    return w.withColumns({"p0": p, "p1": 1 - p})


def frame_posteriors(spark, folder):
    rows = segments.frame_posteriors(_windows(spark, folder))
    return rows.select("file_id", "frame", F.round("p0", 6).alias("p0"))


def word_likelihoods(spark, folder):
    rows = segments.word_likelihoods(spoken_words(spark, folder), segments.frame_posteriors(_windows(spark, folder)))
    return rows.select("file_id", "idx", F.round("l0", 5).alias("l0"))


def viterbi_path(spark, folder):
    """The speaker of every word, from window posteriors to the best path."""
    w = spoken_words(spark, folder)
    like = segments.word_likelihoods(w, segments.frame_posteriors(_windows(spark, folder)))
    like = like.withColumns({c: F.round(c, 9) for c in ("l0", "l1")})  # sums of frames come in any order
    return segments.viterbi(like.join(segments.boundaries(w).select("file_id", "idx", "boundary"), ["file_id", "idx"]))


def two_voices(spark, folder):
    """Posteriors of two voices per recording, its utterances' vectors standing in for windows of audio."""
    u = catalog.utterances(spark, folder, "start_sec", "end_sec", "embedding").where("size(embedding) = 64")
    rows = u.select("file_id", F.col("idx").alias("n"), "start_sec", "end_sec", "embedding")
    return diarization.window_posteriors(rows).select("file_id", "n", F.round("p0", 6).alias("p0"))


def speakers_of_words(spark, folder):
    """The speaker of every word, from voices to names: utterances' vectors stand in for windows of audio."""
    u = catalog.utterances(spark, folder, "start_sec", "end_sec", "embedding").where("size(embedding) = 64 and end_sec > start_sec")
    voices = u.select("file_id", F.col("idx").alias("n"), "start_sec", "end_sec", "embedding")
    return ingest.speakers_of(spoken_words(spark, folder), voices).select("file_id", "idx", "speaker")


def aligned_words(spark, folder):
    """Words aligned with the text of their utterance, one response per utterance."""
    u = catalog.utterances(spark, folder, "text", "words", "end_sec").where("text is not null and size(words) > 0")
    bare = F.transform("words", lambda w: F.struct(F.regexp_replace(w["tok"], r"[?./,;:\"\])]+$", "").alias("word"), w["start_sec"].alias("start"), w["end_sec"].alias("end")))
    segs = F.array(F.struct(F.col("end_sec").alias("end")))
    r = u.select(F.concat_ws(":", "file_id", "idx").alias("file_id"), "text", bare.alias("words"), F.when(F.col("end_sec").isNotNull(), segs).alias("segments"))
    return segments.aligned(r)


def html_turns(spark, folder):
    """A transcript page for each recording, made of its utterances and read back as turns."""
    u = catalog.utterances(spark, folder, "speaker", "text").where("text is not null and speaker is not null")
    line = F.concat(F.lit("<p><strong>"), "speaker", F.lit("</strong></p><p>"), F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>"))
    # pages of at most 256 utterances, so that no page outgrows a row
    page = u.groupBy("file_id", F.floor(F.col("idx") / 256).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))).alias("x"))
    doc = F.concat(F.lit("<div><p><strong>Transcript</strong></p>"), F.array_join(F.transform("x", lambda x: x["l"]), ""), F.lit("</div>"))
    pages = page.select(F.concat_ws(":", "file_id", "part").alias("page_id"), doc.alias("html"))
    return html.html_turns(pages)


def transcript_round_trip(spark, folder):
    """Utterances written as nested JSON and read back, with all their fields."""
    u = catalog.utterances(spark, folder, "speaker", "start_sec", "end_sec", "text", "words")
    none = {"confidence": "double", "n_words": "bigint", "question_rate": "double"}
    s = catalog.speakers(spark, folder).withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
    path = owned(spark, "transcripts")
    transcripts.write_transcripts(transcripts.nested(u, s, catalog.audio_files(spark, folder, "duration_sec")), path)
    # one document per line here; a folder of single documents is read with line breaks in them
    back = transcripts.transcript_tables(spark.read.schema(transcripts.TRANSCRIPT).json(path))["utterances"]
    total = lambda c: F.round(F.aggregate(F.transform("words", lambda w: w[c]), F.lit(0.0), lambda a, x: a + x), 3)
    toks = F.array_join(F.transform("words", lambda w: w["tok"]), " ")
    return back.select("file_id", "idx", "speaker", "start_sec", "end_sec", "text", toks.alias("toks"), total("start_sec").alias("starts"), total("end_sec").alias("ends"))


W = f"""w AS (SELECT file_id, CAST(idx AS BIGINT) * {PER_UTTERANCE} + n - 1 AS idx, coalesce(speaker, '') AS speaker, words[n].tok AS text, words[n].start_sec AS start_sec, words[n].end_sec AS end_sec
          FROM (SELECT *, unnest(range(1, len(words) + 1)) AS n FROM u WHERE words IS NOT NULL))"""
BF = "PARTITION BY file_id ORDER BY idx"
REG = """r0 AS (SELECT *, max(end_sec) OVER (PARTITION BY file_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL),
    r1 AS (SELECT *, sum(CASE WHEN start_sec - reach <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS region FROM r0),
    reg AS (SELECT file_id, region, min(start_sec) AS s, max(end_sec) AS e FROM r1 GROUP BY file_id, region HAVING max(end_sec) - min(start_sec) >= 0.4)"""
WIN = """k AS (SELECT *, greatest(0, CAST(ceil(round((e - s - 1.5) / 0.75, 9)) AS INT)) AS full_n FROM reg),
    win AS (SELECT file_id, region, CAST(n AS INT) AS n, CASE WHEN n < full_n THEN s + n * 0.75 ELSE greatest(s, e - 1.5) END AS s, CASE WHEN n < full_n THEN s + n * 0.75 + 1.5 ELSE e END AS e
            FROM (SELECT *, unnest(range(0, full_n + 1)) AS n FROM k))"""
FRM = """fr AS (SELECT file_id, f, p, 1 - abs((f + 0.5) * 0.1 - (s + e) / 2) / ((e - s) / 2 + 0.1) AS wt FROM
        (SELECT *, 0.5 + 0.4 * sin(n) AS p, unnest(range(CAST(floor(s / 0.1) AS BIGINT), greatest(CAST(floor(s / 0.1) AS BIGINT) + 1, CAST(ceil(e / 0.1) AS BIGINT)))) AS f FROM win)),
    fp AS (SELECT file_id, f AS frame, sum(wt * p) / sum(wt) AS p0 FROM fr GROUP BY file_id, f HAVING sum(wt) > 0)"""
LIKE = """x AS (SELECT file_id, idx, CAST(floor(start_sec / 0.1) AS BIGINT) AS a, greatest(CAST(floor(start_sec / 0.1) AS BIGINT) + 1, CAST(ceil(end_sec / 0.1) AS BIGINT)) AS b FROM w),
        un AS (SELECT x.file_id, x.idx, avg(p0) AS p0 FROM x JOIN fp ON fp.file_id = x.file_id AND frame >= a AND frame < b GROUP BY x.file_id, x.idx),
        br AS (SELECT x.file_id, x.idx, (a + b) // 2 AS t FROM x LEFT JOIN un USING (file_id, idx) WHERE un.p0 IS NULL),
        nr AS (SELECT br.file_id, br.idx, min_by(p0, (abs(frame - t), frame)) AS p0 FROM br LEFT JOIN fp USING (file_id) GROUP BY br.file_id, br.idx),
        lk AS (SELECT * FROM un UNION ALL SELECT * FROM nr)"""
ENDS = (
    "NOT (list_contains(" + stop_list(ABBREVIATIONS) + r", lower({0})) OR regexp_full_match(lower({0}), '([a-z]\.){{{{2,}}}}')) AND regexp_matches({0}, '[.?!][\"'')\]]*$')"
).replace("{{{{", "{{").replace("}}}}", "}}").replace('\\"', '"')
NW = r"len(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> ''))"

QUERIES = {
    f.__name__: f
    for f in (
        monotone_start, turn_boundaries, speech_regions, sliding_windows, turn_merge, first_speaker, segment_ends, passages, utterances_of_words, roles_score,
        frame_posteriors, word_likelihoods, viterbi_path, two_voices, speakers_of_words, aligned_words, html_turns, transcript_round_trip,
    )
}
SQL = {
    "monotone_start": f"""WITH {U}, {W}, x AS (SELECT file_id, idx, max(start_sec) OVER ({BF} ROWS UNBOUNDED PRECEDING) AS s, end_sec FROM w)
        SELECT file_id, idx, round(s, 3) AS start_sec, round(greatest(end_sec, s + 0.02), 3) AS end_sec FROM x""",
    "turn_boundaries": f"""WITH {U}, {W}, e AS (SELECT file_id, max(idx) AS idx FROM w GROUP BY file_id, idx // {PER_UTTERANCE}),
        x AS (SELECT w.*, e.idx IS NOT NULL AS is_end FROM w LEFT JOIN e ON e.file_id = w.file_id AND e.idx = w.idx)
        SELECT file_id, idx, row_number() OVER ({BF}) = 1 OR coalesce(regexp_matches(lag(text) OVER ({BF}), '[.?!]$'), false) OR coalesce(lag(is_end) OVER ({BF}), false)
               OR coalesce(start_sec - lag(end_sec) OVER ({BF}) >= 0.6, false) AS boundary FROM x""",
    "speech_regions": f"WITH {U}, {W}, {REG} SELECT file_id, round(s, 3) AS start_sec, round(e, 3) AS end_sec FROM reg",
    "sliding_windows": f"WITH {U}, {W}, {REG}, {WIN} SELECT file_id, n, round(s, 3) AS start_sec, round(e, 3) AS end_sec FROM win",
    "turn_merge": f"""WITH {U}, x AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER ({BF}) AND row_number() OVER ({BF}) > 1 THEN 0 ELSE 1 END AS nw FROM u),
        y AS (SELECT *, CAST(sum(nw) OVER ({BF} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM x)
        SELECT file_id, turn, min(speaker) AS speaker, min(idx) AS first_idx, max(idx) AS last_idx, string_agg(coalesce(text, ''), ' ' ORDER BY idx) AS text FROM y GROUP BY file_id, turn""",
    "first_speaker": f"""WITH {U} SELECT file_id, idx, CASE WHEN coalesce(speaker, '') = first(coalesce(speaker, '')) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS label FROM u""",
    "segment_ends": f"""WITH {U}, {W}, o AS (SELECT file_id, start_sec, row_number() OVER (PARTITION BY file_id ORDER BY start_sec, idx) AS k FROM w),
        sg AS (SELECT file_id, idx AS seg, max(end_sec) OVER ({BF} ROWS UNBOUNDED PRECEDING) AS t FROM u WHERE end_sec IS NOT NULL)
        SELECT sg.file_id, seg, CAST(max(k) AS INT) AS idx FROM sg JOIN o ON o.file_id = sg.file_id AND o.start_sec < t GROUP BY sg.file_id, seg""",
    "passages": f"""WITH RECURSIVE {U}, x AS (SELECT *, {NW} AS n, row_number() OVER ({BF}) AS p FROM u),
        y AS (SELECT *, CAST(sum(n) OVER ({BF} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, count(*) OVER (PARTITION BY file_id) AS size FROM x),
        z AS (SELECT a.file_id, a.p, any_value(a.size) AS size, coalesce(min(b.p) FILTER (b.cum >= a.cum - a.n + 50), any_value(a.size)) AS j,
                     coalesce(min(b.p) FILTER (b.cum >= a.cum - a.n + 25) + 1, any_value(a.size) + 1) AS k
              FROM y a JOIN y b ON a.file_id = b.file_id AND b.p >= a.p GROUP BY a.file_id, a.p),
        walk AS (SELECT file_id, p, size, j, k, 0 AS n FROM z WHERE p = 1
                 UNION ALL SELECT z.file_id, z.p, z.size, z.j, z.k, w.n + 1 FROM walk w JOIN z ON z.file_id = w.file_id AND z.p = greatest(least(w.k, w.j + 1), w.p + 1) WHERE w.j < w.size),
        wn AS (SELECT file_id, p, least(j, size) AS j, max(n) AS n FROM walk GROUP BY ALL),
        sp AS (SELECT file_id, n, string_agg(speaker, '|' ORDER BY first) AS speakers FROM (SELECT w.file_id, w.n, y.speaker, min(y.p) AS first
               FROM wn w JOIN y ON y.file_id = w.file_id AND y.p BETWEEN w.p AND w.j WHERE y.speaker IS NOT NULL GROUP BY ALL) GROUP BY file_id, n)
        SELECT printf('%s_c%04d', w.file_id, w.n) AS id, w.file_id, CAST(min(y.idx) AS INT) AS utt_start, CAST(max(y.idx) + 1 AS INT) AS utt_end,
               min_by(y.start_sec, y.p) AS start_sec, CASE WHEN bool_or(y.p = w.j AND y.end_sec IS NULL) THEN NULL ELSE max_by(y.end_sec, y.p) END AS end_sec,
               coalesce(any_value(sp.speakers), '') AS speakers, string_agg(coalesce(y.text, ''), ' ' ORDER BY y.p) AS text
        FROM wn w JOIN y ON y.file_id = w.file_id AND y.p BETWEEN w.p AND w.j LEFT JOIN sp ON sp.file_id = w.file_id AND sp.n = w.n GROUP BY w.file_id, w.n, w.p""",
    "roles_score": f"""WITH {U}, x AS (SELECT file_id, speaker AS label, CAST(sum({NW}) AS BIGINT) AS n_words, avg(CASE WHEN ends_with(rtrim(coalesce(text, '')), '?') THEN 1.0::DOUBLE ELSE 0 END) AS q, min(idx) AS first FROM u WHERE speaker IS NOT NULL GROUP BY ALL),
        y AS (SELECT *, round(3 * q + 1.5 * (0.5 - n_words / greatest(sum(n_words) OVER (PARTITION BY file_id), 1)) + 0.5 * CAST(first = min(first) OVER (PARTITION BY file_id) AS INT), 12) AS score FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, first) AS place FROM y),
        m AS (SELECT file_id, max(score) FILTER (place = 1) - max(score) FILTER (place = 2) AS margin FROM z GROUP BY file_id)
        SELECT file_id, label, CASE WHEN place = 1 THEN 'host' ELSE 'guest' END AS role, round(1 / (1 + exp(-4 * coalesce(margin, 1))), 4) AS confidence, n_words, round(q, 4) AS question_rate FROM z JOIN m USING (file_id)""",
    "frame_posteriors": f"WITH {U}, {W}, {REG}, {WIN}, {FRM} SELECT file_id, frame, round(p0, 6) AS p0 FROM fp",
    "word_likelihoods": f"""WITH {U}, {W}, {REG}, {WIN}, {FRM}, {LIKE}
        SELECT file_id, idx, round(ln(least(1.0, greatest(1e-4, coalesce(p0, 0.5)))), 5) AS l0 FROM lk""",
    "transcript_round_trip": f"""WITH {U}, {A} SELECT file_id, idx, speaker, start_sec, end_sec, text,
        CASE WHEN words IS NOT NULL THEN coalesce(array_to_string(list_transform(words, lambda w: w.tok), ' '), '') END AS toks,
        CASE WHEN words IS NOT NULL THEN round(coalesce(list_sum(list_transform(words, lambda w: w.start_sec)), 0), 3) END AS starts,
        CASE WHEN words IS NOT NULL THEN round(coalesce(list_sum(list_transform(words, lambda w: w.end_sec)), 0), 3) END AS ends
        FROM u WHERE file_id IN (SELECT file_id FROM a)""",
    "html_turns": rf"""WITH {U}, b AS (SELECT file_id || ':' || (idx // 256) AS page_id, idx, unnest([{{'k': 0, 't': speaker}}, {{'k': 1, 't': text}}]) AS b FROM u WHERE text IS NOT NULL AND speaker IS NOT NULL),
        n AS (SELECT page_id, idx, b.k AS k, trim(regexp_replace(replace(b.t, chr(160), ' '), '\s+', ' ', 'g')) AS t FROM b),
        m AS (SELECT *, k = 0 AND len(string_split(t, ' ')) <= 6 AND right(t, 1) NOT IN ('.', '?', '!') AS mark FROM n WHERE t <> ''),
        x AS (SELECT *, sum(CAST(mark AS INT)) OVER (PARTITION BY page_id ORDER BY idx, k ROWS UNBOUNDED PRECEDING) AS tn FROM m),
        g AS (SELECT page_id, tn, any_value(t) FILTER (mark) AS t, string_agg(t, ' ' ORDER BY idx, k) FILTER (NOT mark AND NOT regexp_full_match(t, '[<\[][^>\]]*[>\]]')) AS said FROM x WHERE tn > 0 GROUP BY page_id, tn),
        w AS (SELECT page_id, tn, regexp_replace(rtrim(t, ':'), '\s*\(host\)$', '', 'i') AS who, said FROM g WHERE said IS NOT NULL),
        v AS (SELECT *, CASE WHEN who IS NOT DISTINCT FROM lag(who) OVER (PARTITION BY page_id ORDER BY tn) THEN 0 ELSE 1 END AS nw FROM w WHERE NOT starts_with(who, '<')),
        y AS (SELECT *, sum(nw) OVER (PARTITION BY page_id ORDER BY tn ROWS UNBOUNDED PRECEDING) AS turn FROM v)
        SELECT page_id, CAST(turn - 1 AS INT) AS turn, min(who) AS speaker, string_agg(said, ' ' ORDER BY tn) AS text FROM y GROUP BY page_id, turn""",
    "utterances_of_words": f"""WITH RECURSIVE {U}, {W},
        x AS (SELECT *, CAST(coalesce(speaker <> lag(speaker) OVER ({BF}), false) OR coalesce(start_sec - lag(end_sec) OVER ({BF}) >= 1.5, false)
                     OR coalesce({ENDS.format(f"lag(text) OVER ({BF})")}, false) AS INT) AS nw FROM w),
        y AS (SELECT *, sum(nw) OVER ({BF} ROWS UNBOUNDED PRECEDING) AS piece FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY file_id, piece ORDER BY idx) AS k, count(*) OVER (PARTITION BY file_id, piece) AS size FROM y),
        full_ AS (SELECT file_id, piece, a.k - 1 AS a, a.k - 1 + coalesce(max(b.k - a.k + 1) FILTER (ends_with(b.text, ',') AND b.k - a.k + 1 > 26), 50) AS b
                  FROM z a JOIN z b USING (file_id, piece) WHERE a.size >= a.k + 49 AND b.k BETWEEN a.k AND a.k + 49 GROUP BY file_id, piece, a.k),
        cut AS (SELECT DISTINCT file_id, piece, CAST(0 AS BIGINT) AS a FROM z UNION ALL SELECT c.file_id, c.piece, f.b FROM cut c JOIN full_ f ON f.file_id = c.file_id AND f.piece = c.piece AND f.a = c.a),
        g AS (SELECT z.*, max(c.a) AS a FROM z JOIN cut c ON c.file_id = z.file_id AND c.piece = z.piece AND c.a < z.k GROUP BY ALL),
        o AS (SELECT file_id, piece, a, min_by(speaker, k) AS speaker, min_by(start_sec, k) AS start_sec, max_by(end_sec, k) AS end_sec, string_agg(text, ' ' ORDER BY k) AS text FROM g GROUP BY ALL)
        SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY piece, a) - 1 AS INT) AS idx, speaker, start_sec, end_sec, text FROM o""",
    "viterbi_path": f"""WITH RECURSIVE {U}, {W}, {REG}, {WIN}, {FRM}, {LIKE},
        bd AS (SELECT file_id, idx, row_number() OVER ({BF}) = 1 OR coalesce(regexp_matches(lag(text) OVER ({BF}), '[.?!]$'), false) OR coalesce(start_sec - lag(end_sec) OVER ({BF}) >= 0.6, false) AS free,
                      row_number() OVER ({BF}) AS k FROM w),
        v AS (SELECT bd.file_id, bd.idx, k, CASE WHEN free THEN 0.6 ELSE 4.0 END AS cost, round(ln(least(1.0, greatest(1e-4, coalesce(p0, 0.5)))), 9) AS l0, round(ln(least(1.0, greatest(1e-4, 1 - coalesce(p0, 0.5)))), 9) AS l1
              FROM bd JOIN lk ON lk.file_id = bd.file_id AND lk.idx = bd.idx),
        f AS (SELECT file_id, k, l0 AS s0, l1 AS s1, 0 AS f0, 0 AS f1 FROM v WHERE k = 1
              UNION ALL SELECT v.file_id, v.k, greatest(s0, s1 - cost) + l0, greatest(s0 - cost, s1) + l1, CASE WHEN s0 >= s1 - cost THEN 0 ELSE 1 END, CASE WHEN s0 - cost >= s1 THEN 0 ELSE 1 END
              FROM f JOIN v ON v.file_id = f.file_id AND v.k = f.k + 1),
        b AS (SELECT file_id, k, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS path, CASE WHEN s0 >= s1 THEN f0 ELSE f1 END AS prev FROM f QUALIFY k = max(k) OVER (PARTITION BY file_id)
              UNION ALL SELECT f.file_id, f.k, b.prev, CASE WHEN b.prev = 0 THEN f0 ELSE f1 END FROM b JOIN f ON f.file_id = b.file_id AND f.k = b.k - 1)
        SELECT v.file_id, v.idx, CAST(path AS INT) AS path FROM b JOIN v ON v.file_id = b.file_id AND v.k = b.k""",
}
