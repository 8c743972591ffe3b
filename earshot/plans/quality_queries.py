"""Queries that judge results, and that keep the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import evaluation, library
from earshot.plans.sql import A, C, H, S, U
from earshot.session import owned
from earshot.sources import catalog
from earshot.sources.store import list_folder
from earshot.sources.tables import table
from earshot.streaming import sessions


def _hits(spark, folder):
    return catalog.hits(spark, folder, "query_id", "rank", "file_id", "start_sec", "end_sec", "related")


def interval_eval_join(spark, folder):
    return evaluation.covering_hits(_hits(spark, folder), evaluation.labels_of(catalog.queries(spark, folder)))


def recall_mrr(spark, folder):
    return evaluation.scores(catalog.queries(spark, folder), _hits(spark, folder))


def label_merge(spark, folder):
    rows = evaluation.merge_close(evaluation.labels_of(catalog.queries(spark, folder)).drop("n"), gap_sec=600.0)
    return rows.select("query_id", "file_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "grade", "quote")


def label_ranges(spark, folder):
    """The utterances of every passage as a reference, resolved to times and a quote."""
    c = catalog.chunks(spark, folder, "file_id", "utt_start", "utt_end")
    ref = F.concat("file_id", F.lit(":"), F.col("utt_start").cast("string"), F.lit("-"), (F.col("utt_end") - 1).cast("string"), F.lit("@1"))
    return evaluation.resolve_labels(c.select(F.col("id").alias("query_id"), ref.alias("ref")), catalog.utterances(spark, folder, "start_sec", "end_sec", "text"), digits=3)


def frozen_labels(spark, folder):
    """Queries whose labels are dropped and taken back from the frozen development split."""
    q = catalog.queries(spark, folder)
    new = q.withColumn("relevant", F.slice("relevant", 1, 0))
    rows = evaluation.keep_frozen(new, q.where("split = 'dev'"))
    return rows.select("query_id", F.size("relevant").alias("n"))


def category_counts(spark, folder):
    q = catalog.queries(spark, folder)
    return q.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("relevant")).cast("long").alias("labels"))


def library_listing(spark, folder):
    """The recordings that hits name as the manifest; chunks of recordings nobody knows as jobs."""
    manifest = catalog.hits(spark, folder, "file_id", "title").groupBy("file_id").agg(F.min("title").alias("title"))
    audio = catalog.audio_files(spark, folder, "duration_sec")
    jobs = catalog.utterances(spark, folder, "speaker").groupBy("file_id").agg(F.lit("queued").alias("status"), F.min("file_id").alias("title"))
    jobs = jobs.join(audio.where("duration_sec > 200"), "file_id", "left_anti")
    return library.listing(manifest, audio, jobs)


def set_equality(spark, folder):
    return library.differs(catalog.audio_files(spark, folder, "title"), catalog.utterances(spark, folder, "speaker"))


def removal(spark, folder):
    """Rows left per table when all recordings under five minutes are removed."""
    tables = {n: table(spark, folder, n) for n in ("audio_files", "chunks", "hits", "speakers", "utterances")}
    left = library.without(tables, table(spark, folder, "audio_files").where("duration_sec < 300"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_ids(spark, folder):
    """The recordings that the table of speakers lists more than once."""
    return library.duplicate_ids(table(spark, folder, "speakers"))


def not_built(spark, folder):
    return library.not_built(catalog.audio_files(spark, folder, "title"), catalog.utterances(spark, folder, "speaker").select("file_id").distinct()).select("file_id")


def orphan_hits(spark, folder):
    return library.orphans(catalog.hits(spark, folder, "file_id"), catalog.audio_files(spark, folder, "title"), ["file_id"]).select("hit_id", "file_id")


def ingest_summary(spark, folder):
    """What came in per recording: utterances, words, and who has which role."""
    u = catalog.utterances(spark, folder, "text")
    n = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    sums = u.groupBy("file_id").agg(F.count(F.lit(1)).alias("utterances"), F.sum(n).alias("words"))
    who = F.concat("label", F.lit("="), "role")
    s = catalog.speakers(spark, folder).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(who)), " ").alias("roles"))
    return sums.join(s, "file_id", "left")


def event_sessions(spark, folder):
    rows = sessions.activity_sessions(table(spark, folder, "events"), gap="8 hours")
    return rows.select("user_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("begin", "finish")], "n")


def streamed_sessions(spark, folder):
    """The same sessions, kept by a stream of the events' files."""
    events = table(spark, folder, "events")
    landed = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1)
    inside = any(name.endswith(".parquet") for name in list_folder(spark, f"{folder}/events.parquet") if name != "events.parquet")
    stream = landed.parquet(f"{folder}/events.parquet") if inside else landed.option("pathGlobFilter", "events.parquet").parquet(folder)
    path = owned(spark, "sessions")
    sessions.sessions_so_far(stream, path, owned(spark, "sessions-checkpoint"), gap="8 hours").awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select("user_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us") for c in ("begin", "finish")], "n")


HL = f"{H}, l AS (SELECT query_id, CAST(i - 1 AS INT) AS n, relevant[i].file_id AS file_id, relevant[i].start_sec AS s, relevant[i].end_sec AS e, relevant[i].grade AS grade, relevant[i].quote AS quote FROM (SELECT *, unnest(range(1, len(relevant) + 1)) AS i FROM queries))"
PAIRS = "pr AS (SELECT l.query_id, n, hit_id, rank FROM h JOIN l ON h.query_id = l.query_id AND h.file_id = l.file_id AND h.start_sec <= e + 5 AND h.end_sec >= s - 5)"
KS = evaluation.CUTS

QUERIES = {
    f.__name__: f
    for f in (
        interval_eval_join, recall_mrr, label_merge, label_ranges, frozen_labels, category_counts, library_listing, set_equality, removal, duplicate_ids,
        not_built, orphan_hits, ingest_summary, event_sessions, streamed_sessions,
    )
}
_SUMS = ["n_match", "n_related", "ok_match", "ok_related", "labels", *[f"{x}_{k}" for k in KS for x in ("found", "best")]]
_RATIO = "round({0} / nullif({1}, 0)::DOUBLE, 6)"
SQL = {
    "interval_eval_join": f"WITH {HL}, {PAIRS} SELECT query_id, n, hit_id, rank FROM pr",
    "recall_mrr": f"""WITH {HL}, {PAIRS}, g AS (SELECT DISTINCT query_id, hit_id FROM pr),
        ph AS (SELECT h.query_id, count(*) FILTER (NOT related) AS n_match, count(*) FILTER (related) AS n_related, count(*) FILTER (NOT related AND g.hit_id IS NOT NULL) AS ok_match,
                 count(*) FILTER (related AND g.hit_id IS NOT NULL) AS ok_related, min(rank) FILTER (g.hit_id IS NOT NULL) AS first FROM h LEFT JOIN g ON g.query_id = h.query_id AND g.hit_id = h.hit_id GROUP BY h.query_id),
        pl AS (SELECT query_id, {", ".join(f"count(*) FILTER (pos <= {k}) AS found_{k}" for k in KS)} FROM (SELECT query_id, n, min(rank) AS pos FROM pr GROUP BY ALL) GROUP BY query_id),
        r AS (SELECT q.query_id, coalesce(category, 'none') AS category, len(relevant) AS labels, {", ".join(f"least({k}, len(relevant)) AS best_{k}" for k in KS)}, ph.* EXCLUDE query_id, pl.* EXCLUDE query_id
              FROM queries q LEFT JOIN ph USING (query_id) LEFT JOIN pl USING (query_id)),
        b AS (SELECT category, count(*) AS queries, sum(coalesce(1.0::DOUBLE / first, 0)) AS rr, {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _SUMS)} FROM r GROUP BY ROLLUP (category))
        SELECT coalesce(category, 'ALL') AS category, queries, {", ".join(_SUMS)}, {_RATIO.format("ok_match", "n_match")} AS match_p, {_RATIO.format("ok_related", "n_related")} AS related_p,
          {", ".join(f"{_RATIO.format(f'found_{k}', 'labels')} AS recall_{k}" for k in KS)}, {", ".join(f"{_RATIO.format(f'best_{k}', 'labels')} AS best_recall_{k}" for k in KS)}, {_RATIO.format("rr", "queries")} AS mrr FROM b""",
    "label_merge": f"""WITH {HL}, x AS (SELECT *, max(e) OVER (PARTITION BY query_id, file_id ORDER BY s, e, quote ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l),
        y AS (SELECT *, sum(CASE WHEN s - reach < 600 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, file_id ORDER BY s, e, quote ROWS UNBOUNDED PRECEDING) AS run FROM x)
        SELECT query_id, file_id, round(min(s), 3) AS start_sec, round(max(e), 3) AS end_sec, max(grade) AS grade,
          CASE WHEN count(*) > 1 THEN left(string_agg(quote, ' [...] ' ORDER BY s, e, quote), 240) ELSE min(quote) END AS quote FROM y GROUP BY query_id, file_id, run""",
    "label_ranges": f"""WITH {C}, {U}, x AS (SELECT id, c.file_id, utt_start, utt_end, regexp_full_match(c.file_id, '[a-z0-9_]+') AS ok FROM c),
        y AS (SELECT x.id, x.file_id, utt_start, utt_end, ok, count(u.idx) AS n, min_by(u.start_sec, u.idx) AS s, max_by(u.end_sec, u.idx) FILTER (u.end_sec IS NOT NULL) AS e,
                bool_or(u.idx = utt_end - 1 AND u.end_sec IS NULL) AS open_end, string_agg(coalesce(u.text, ''), ' ' ORDER BY u.idx) FILTER (u.idx IS NOT NULL) AS q
              FROM x LEFT JOIN u ON ok AND u.file_id = x.file_id AND u.idx BETWEEN utt_start AND utt_end - 1 GROUP BY ALL)
        SELECT id AS query_id, y.file_id || ':' || utt_start || '-' || (utt_end - 1) || '@1' AS ref, CASE WHEN ok THEN y.file_id END AS file_id, round(s, 3) AS start_sec,
          CASE WHEN open_end THEN NULL ELSE round(e, 3) END AS end_sec, CASE WHEN ok THEN 1 END AS grade, CASE WHEN len(coalesce(q, '')) > 240 THEN left(q, 237) || '...' ELSE coalesce(q, '') END AS quote,
          CASE WHEN NOT ok THEN 'bad reference' WHEN n <> utt_end - utt_start THEN 'utterance range out of bounds' END AS error FROM y""",
    "frozen_labels": "SELECT query_id, CAST(CASE WHEN split = 'dev' THEN len(relevant) ELSE 0 END AS INT) AS n FROM queries",
    "category_counts": "SELECT split, category, count(*) AS n, CAST(sum(len(relevant)) AS BIGINT) AS labels FROM queries GROUP BY split, category",
    "library_listing": f"""WITH {H}, {A}, {U}, m AS (SELECT file_id, min(title) AS title FROM h GROUP BY file_id),
        j AS (SELECT DISTINCT file_id, file_id AS title, 'queued' AS status FROM u WHERE file_id NOT IN (SELECT file_id FROM a WHERE duration_sec > 200))
        SELECT m.file_id, coalesce(m.title, m.file_id) AS title, duration_sec AS duration, coalesce(j.status, CASE WHEN a.file_id IS NOT NULL THEN 'ready' ELSE 'not indexed' END) AS status
        FROM m LEFT JOIN a USING (file_id) LEFT JOIN j USING (file_id)
        UNION ALL SELECT file_id, title, NULL, status FROM j WHERE file_id NOT IN (SELECT file_id FROM m WHERE file_id IS NOT NULL)""",
    "set_equality": """SELECT DISTINCT file_id, 'second' AS missing_in FROM audio_files WHERE file_id NOT IN (SELECT file_id FROM utterances)
        UNION ALL SELECT DISTINCT file_id, 'first' FROM utterances WHERE file_id NOT IN (SELECT file_id FROM audio_files)""",
    "removal": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n FROM {n} WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM audio_files WHERE duration_sec < 300)" for n in ("audio_files", "chunks", "hits", "speakers", "utterances")
    ),
    "duplicate_ids": "SELECT file_id FROM speakers GROUP BY file_id HAVING count(*) > 1",
    "not_built": "SELECT DISTINCT file_id FROM audio_files WHERE file_id NOT IN (SELECT file_id FROM utterances)",
    "orphan_hits": f"WITH {H} SELECT hit_id, file_id FROM h WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM audio_files)",
    "ingest_summary": rf"""WITH {U}, {S}, x AS (SELECT file_id, count(*) AS utterances, CAST(sum(len(list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM u GROUP BY file_id),
        y AS (SELECT file_id, string_agg(label || '=' || role, ' ' ORDER BY label || '=' || role) AS roles FROM s GROUP BY file_id)
        SELECT x.file_id, utterances, words, roles FROM x LEFT JOIN y USING (file_id)""",
    "event_sessions": """WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS nw FROM events),
        y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
        SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts) + INTERVAL 8 HOUR) AS finish_us, count(*) AS n FROM y GROUP BY user_id, run""",
}
SQL["streamed_sessions"] = SQL["event_sessions"]
