"""From passages to moments: the best sentence, its highlights, near-duplicates in time, and complete hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import overlap


def lexical_weight(mode: Column, intent: Column) -> Column:
    """How much the words of a sentence count against its meaning."""
    return F.when(mode == "semantic", 0.3).when(intent.isin("keyword", "phrase"), 0.8).otherwise(0.5)


def snap(candidates: DataFrame, *, lex_w: Column | float = 0.5) -> DataFrame:
    """The best sentence of each (query_id, id): one row of ``candidates`` (query_id, id, idx, lex, sem, n_words, ...).

    ``lex`` is the mass of the query's words in the sentence, divided by the passage's best; ``sem`` the cosine, stretched
    to 0..1 over the passage, and halved afterwards for sentences under four words. Without any match of words only the
    meaning counts. Equal sentences: the first by idx. Null measures count as 0.
    """
    of = Window.partitionBy("query_id", "id")
    lex, sem = F.coalesce("lex", F.lit(0.0)), F.coalesce("sem", F.lit(0.0))
    rows = candidates.withColumns({"__top": F.max(lex).over(of), "__hi": F.max(sem).over(of), "__lo": F.min(sem).over(of)})
    lex_n = F.when(F.col("__top") > 0, lex / F.col("__top")).otherwise(lex)
    spread = F.col("__hi") - F.col("__lo")
    sem_n = F.when(spread > 0, (sem - F.col("__lo")) / spread * F.when(F.col("n_words") < 4, 0.5).otherwise(1.0)).otherwise(0.0)
    w = F.when(F.col("__top") > 0, lex_w if isinstance(lex_w, Column) else F.lit(lex_w)).otherwise(0.0)
    rows = rows.withColumn("__score", F.round(w * lex_n + (1 - w) * sem_n, 9))
    rows = rows.withColumn("__r", F.row_number().over(of.orderBy(F.col("__score").desc(), "idx"))).where("__r = 1")
    return rows.withColumnRenamed("__score", "snap_score").drop("__top", "__hi", "__lo", "__r")


def highlights(words: Column, wanted: Column, term) -> Column:
    """Array of (a, b): the character spans of the words whose lexeme is wanted, in the words joined by blanks.

    ``term`` turns a word into its lexemes; a span is the word without what surrounds its letters and digits.
    """
    toks = F.transform(words, lambda w: w["tok"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc, tok):
        lead = F.length(F.regexp_extract(tok, r"^([^\p{L}\p{N}]*)", 1))
        core = F.length(F.regexp_replace(tok, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        span = F.struct((acc["at"] + lead).alias("a"), (acc["at"] + lead + core).alias("b"))
        hit = (core > 0) & F.arrays_overlap(term(tok), wanted)
        spans = F.when(hit, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(tok) + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(toks, start, step, lambda acc: acc["spans"])


def match_time(words: Column, spans: Column, start: Column) -> Column:
    """When the first highlighted word is spoken: the first word that reaches past the span's begin, else ``start``."""
    first = F.get(spans, 0)["a"]
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("t"))

    def step(acc, w):
        past = acc["t"].isNull() & (acc["at"] + F.length(w["tok"]) > first)
        return F.struct((acc["at"] + F.length(w["tok"]) + 1).alias("at"), F.when(past, w["start_sec"]).otherwise(acc["t"]).alias("t"))

    return F.coalesce(F.aggregate(words, zero, step, lambda acc: acc["t"]), start)


def spans_of_marks(marked: Column, opens: str = "\u0002", closes: str = "\u0003") -> Column:
    """Array of (a, b): the spans between marks, measured in the text without them; empty spans are dropped."""
    parts = F.split(marked, opens)
    zero = F.struct(F.length(F.get(parts, 0)).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc, part):
        inside = F.length(F.substring_index(part, closes, 1))
        size = F.length(F.replace(part, F.lit(closes), F.lit("")))
        closed = F.contains(part, F.lit(closes)) & (inside > 0)
        span = F.struct(acc["at"].alias("a"), (acc["at"] + inside).alias("b"))
        return F.struct((acc["at"] + size).alias("at"), F.when(closed, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), zero, step, lambda acc: acc["spans"])


def distinct_moments(moments: DataFrame, *, gap_sec: float = 10.0, most_overlap: float = 0.5) -> DataFrame:
    """The moments kept, best first, when those near a better one of the same query and recording are dropped.

    ``moments`` (query_id, rank, file_id, idx, start_sec, p_start, p_end, ...): p_start and p_end are the passage. A moment
    falls to a kept one of the same utterance, that starts less than ``gap_sec`` away, or whose passage shares more than
    ``most_overlap``. Only moments of one recording can fall to each other, and only within an island of time; each island
    is decided on its own, so no query and no recording has to fit into one task.
    """
    along = Window.partitionBy("query_id", "file_id").orderBy("__a", "rank")
    a = F.least("start_sec", F.coalesce("p_start", "start_sec"))
    b = F.greatest(F.col("start_sec") + gap_sec, F.coalesce("p_end", "start_sec"))
    rows = moments.where("start_sec is not null").withColumn("__a", a).withColumn("__b", b)
    reach = F.max("__b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(F.col("__a") <= reach, 0).otherwise(1))
    rows = rows.withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct(*[F.col(c).alias(n) for c, n in (("rank", "r"), ("idx", "i"), ("start_sec", "s"), ("p_start", "a"), ("p_end", "b"))])
    islands = rows.groupBy("query_id", "file_id", "__island").agg(F.array_sort(F.collect_list(one)).alias("ms"))
    none = F.slice("ms", 1, 0)

    def near(k, m):
        close = F.coalesce(k["i"] == m["i"], F.lit(False)) | (F.abs(k["s"] - m["s"]) < gap_sec)
        return close | F.coalesce(overlap(k["a"], k["b"], m["a"], m["b"]) > most_overlap, F.lit(False))

    step = lambda kept, m: F.when(F.exists(kept, lambda k: near(k, m)), kept).otherwise(F.concat(kept, F.array(m)))
    alone = islands.where("size(ms) = 1").select("query_id", "ms")
    more = islands.where("size(ms) > 1").select("query_id", F.aggregate("ms", none, step).alias("ms"))
    kept = alone.unionByName(more).select("query_id", F.explode("ms").alias("m")).select("query_id", F.col("m.r").alias("rank"))
    return moments.join(kept, ["query_id", "rank"])


def complete_hits(moments: DataFrame, audio: DataFrame, speakers: DataFrame) -> DataFrame:
    """``moments`` (file_id, speaker, ...) with title, role and name; an unknown recording is its own title, a role 'unknown'."""
    a = audio.select("file_id", "title")
    s = speakers.select("file_id", F.col("label").alias("speaker"), "role", "name")
    rows = moments.join(a, "file_id", "left").join(s, ["file_id", "speaker"], "left")
    return rows.withColumns({"title": F.coalesce("title", "file_id"), "role": F.coalesce("role", F.lit("unknown"))})


def split_sure(moments: DataFrame, *, rerank_min: float = 0.83) -> DataFrame:
    """Add ``related``: whether a moment is neither judged close enough (``rerank``) nor has every word (``coverage``)."""
    sure = (F.coalesce("rerank", F.lit(0.0)) >= rerank_min) | (F.coalesce("coverage", F.lit(0.0)) > 0.99)
    return moments.withColumn("related", ~sure)


def final_order() -> list[Column]:
    """Sure moments first, by their judgement; then the related ones by late interaction; then the fused rank."""
    return [
        F.col("related").asc(),
        F.when(~F.col("related"), F.col("rerank")).desc_nulls_last(),
        F.when(F.col("related"), F.col("late")).desc_nulls_last(),
        F.col("fused_rank").asc(),
    ]
