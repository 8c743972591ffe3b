"""Speaker turns from dirty transcripts: one clock, one name per speaker, spoken words only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.ranking import PART, Along, carried, placed, running_total
from earshot.operators.versions import latest
from earshot.session import cut

UNKNOWN = "unknown"
#: Clock times with or without brackets, in any place of the text.
CLOCK = r"[\[(<]?(?<![\d:.])\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?![\d:])[\])>]?"
#: What stands for a sound: brackets of any kind (a square bracket before a colon is a speaker mark), stars, music.
SOUNDS = [r"\(+[^()]*\)+", r"\{[^{}]*\}", r"<[^<>]*>", r"\*[^*]+\*", r"♪[^♪.?!]{0,60}♪|♪", r"\[[^\[\]]*\](?!\s*:)"]
#: A mark at the head: '[Name]:', 'Name:' or 'Name -', with or without '>>'.
MARK = r"^\s*(>>+\s*)?(?:\[([^\[\]]{1,60})\]\s*:|([^:\[\]>,.?!]{1,60}?)(?:\s*:|\s+-)(?=\s|$))"
#: Marks that are recognised without the table of speakers.
PLAIN_MARK = r"^(?:(?:SPEAKER|SPK|S) ?\d+|SPEAKER|HOST|GUEST|UNKNOWN)$"
#: Hesitation sounds, however drawn out.
HESITATION = r"(?i)(?<![\p{L}\p{N}'’-])(?:u+h+m*|u+m+|e+r+m*|a+h+|e+h+|h+m+|m+h+m+|m{2,}|mm-?hm+)(?![\p{L}\p{N}'’])[,.…]*"


def name_key(name: Column) -> Column:
    """A speaker's name or label in one form: upper case, single blanks, numbers as '#n'. Empty if nothing is left."""
    plain = F.upper(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")))
    number = F.regexp_extract(plain, r"^(?:SPEAKER|SPK|S) ?0*(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("#"), number)).otherwise(plain)


def without_sounds(text: Column, words: Column) -> Column:
    """What is written of an utterance (its words where the text is null) without clock times and sound annotations."""
    said = F.coalesce(text, F.array_join(F.transform(words, lambda w: w["tok"]), " "), F.lit(""))
    said = F.regexp_replace(F.translate(said, "\u00a0", " "), CLOCK, " ")
    for sound in SOUNDS:
        said = F.regexp_replace(said, sound, " ")
    return said


def spoken(said: Column) -> Column:
    """Without hesitation sounds and spare blanks; empty if no word is left."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(said, HESITATION, " "), r"\s+", " "))
    return F.when(rest.rlike(r"[\p{L}\p{N}]"), rest).otherwise("")


def speaker_keys(speakers: DataFrame) -> DataFrame:
    """(file_id, key, label): every way to mean exactly one speaker of a recording.

    Label and number come before the full name (also turned round), that before a part of it, that before the role; a
    key that means several speakers at its best level means none. Null labels are left out, repeated rows count once.
    """
    s = speakers.where("file_id is not null and label is not null").select("file_id", "label", "role", name_key(F.col("name")).alias("n")).distinct()
    parts = F.filter(F.split("n", " "), lambda p: F.length(p) > 1)
    turned = F.concat_ws(" ", F.element_at(F.split("n", " "), -1), F.regexp_replace("n", r" ?\S+$", ""))
    known = F.col("n").isNotNull() & (F.col("n") != "")
    pair = lambda key, level: F.struct(key.alias("key"), F.lit(level).alias("level"))
    ways = F.concat(
        F.array(pair(name_key(F.col("label")), 0), pair(name_key(F.col("role")), 3)),
        F.when(known, F.array(pair(F.col("n"), 1), pair(F.trim(turned), 1))).otherwise(F.array()),
        F.when(known, F.transform(parts, lambda p: pair(p, 2))).otherwise(F.array()),
    )
    rows = s.select("file_id", "label", F.inline(ways)).where("key is not null and key <> ''")
    rows = rows.groupBy("file_id", "key", "level").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    rows = rows.groupBy("file_id", "key").agg(F.min_by(F.struct("lo", "hi"), "level").alias("b"))
    return rows.where("b.lo = b.hi").select("file_id", "key", F.col("b.lo").alias("label"))


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``y`` in squares: neighbours that go backwards are pooled."""
    if len(y) < 2 or (np.diff(y) >= 0).all():
        return y
    total, size = [], []
    for v in y.tolist():
        total.append(v)
        size.append(1)
        while len(total) > 1 and total[-2] * size[-1] > total[-1] * size[-2]:
            t, n = total.pop(), size.pop()
            total[-1] += t
            size[-1] += n
    return np.repeat(np.array(total) / np.array(size), size)


def fit_stretch(pdf: pd.DataFrame) -> pd.DataFrame:
    """The fitted starts of one stretch of utterances that go backwards, and the first of them."""
    pdf = pdf.sort_values("idx")
    start = pdf["start"].to_numpy(dtype=np.float64, na_value=np.nan)
    known = np.isfinite(start)
    fit = isotonic(start[known])
    # a start that is missing takes that of the row before it
    every = fit[np.clip(np.cumsum(known) - 1, 0, None)]
    return pd.DataFrame({"file_id": pdf["file_id"].to_numpy(), "idx": pdf["idx"].to_numpy(), "fit": every, "first_fit": fit[0]})


def repaired_clock(rows: DataFrame, *, reset_sec: float = 60.0) -> DataFrame:
    """(file_id, idx, segment, level, fixed_start, fixed_end) for rows (file_id, idx, start_sec, end_sec), one per key.

    A start more than ``reset_sec`` before the one recorded last is a clock that began anew: a new segment. Within a
    segment the starts are made non-decreasing in the order of idx by isotonic regression.

    Where every start so far is at or before every start still to come, the regression falls apart: neither side changes
    the other. Between such clean cuts lie stretches, most of a single row, which keeps its start; only longer ones, those
    that go backwards, are fitted. So the fit of each stretch is that of the whole segment, and no recording has to fit
    into a task; a stretch does. ``level`` is the first fitted start of the stretch.

    A missing (null or NaN) start takes the fitted one before it in its segment, else the next; it is null if the segment
    has none. A missing end, or one before the start, becomes the next start that is later.
    """
    valid = lambda c: F.when(~F.isnan(c) & (F.abs(c) < 1e300), F.col(c).cast("double"))
    line = rows.select("file_id", "idx", valid("start_sec").alias("start"), valid("end_sec").alias("stop"))
    line = placed(line, ["file_id"], [F.col("idx").asc()], "clock")
    line = carried(line, ["file_id"], ["idx"], {"prev": Along("last", F.col("start"), inclusive=False)})
    reset = F.coalesce((F.col("start") < F.col("prev") - F.lit(reset_sec)).cast("long"), F.lit(0).cast("long"))
    line = cut(carried(line, ["file_id"], ["idx"], {"segment": Along("sum", reset)}).drop("prev"), "clock-segments")
    s = F.col("start")
    line = carried(line, ["file_id", "segment"], ["idx"], {
        "top": Along("max", s), "top_before": Along("max", s, inclusive=False),
        "low": Along("min", s, backward=True), "low_after": Along("min", s, inclusive=False, backward=True),
    })
    clean = lambda before, after: F.coalesce(F.col(after) >= F.col(before), F.lit(True))
    line = line.withColumns({"begins": clean("top_before", "low"), "ends": clean("top", "low_after")})
    line = cut(line.drop(PART, "top_before", "low"), "clock-cuts")
    messy = line.where("not (begins and ends)").select("file_id", "segment", "idx", "start", F.col("begins").cast("long").alias("b"))
    messy = running_total(messy, ["file_id"], [F.col("idx").asc()], F.col("b"), "stretch", "clock-stretches")
    kind = dict(rows.dtypes)["idx"]
    fitted = messy.select("file_id", "segment", "stretch", "idx", "start").groupBy("file_id", "stretch").applyInPandas(fit_stretch, f"file_id string, idx {kind}, fit double, first_fit double")
    line = line.join(fitted.hint("merge"), ["file_id", "idx"], "left")
    start = F.coalesce("fit", "start", "top", "low_after")
    end = F.when(F.col("stop") >= start, F.col("stop")).otherwise(F.greatest(start, "low_after"))
    return line.select("file_id", "idx", "segment", F.coalesce("first_fit", start).alias("level"), start.alias("fixed_start"), end.alias("fixed_end"))


def labelled_utterances(utterances: DataFrame, speakers: DataFrame, *, salt: int = 8) -> DataFrame:
    """Each utterance with spoken words once: file_id, idx, segment, level, at, label, fixed_start, fixed_end and text.

    Utterances follow each other by (segment, level, at, idx): the repaired clock puts segments and stretches in order, and
    within a stretch that goes backwards the recorded start ``at`` decides (the repaired one where none was recorded). As
    stretches don't overlap, that is the order of recorded starts within each segment. The latest row of a key counts;
    null keys are left out. The table of speakers is repeated ``salt`` times, so that a hot recording is joined by several tasks.
    """
    rows = utterances.where("file_id is not null and idx is not null").select("file_id", "idx", "speaker", "start_sec", "end_sec", "ingested_at", without_sounds(F.col("text"), F.col("words")).alias("said"))
    head = F.regexp_extract("said", MARK, 0)
    mark = F.when(head != "", name_key(F.concat(F.regexp_extract("said", MARK, 2), F.regexp_extract("said", MARK, 3))))
    rows = rows.withColumn("head", head).withColumn("mark", mark).withColumn("key", name_key(F.col("speaker")))
    rest = spoken(F.expr("substring(said, length(head) + 1)"))
    keep = spoken(F.col("said"))
    sure = F.coalesce(F.col("mark").rlike(PLAIN_MARK) | F.col("mark").startswith("#") | F.col("head").contains(">>") | F.col("head").contains("["), F.lit(False))
    rows = rows.select("file_id", "idx", "start_sec", "end_sec", "ingested_at", "key", "mark", sure.alias("sure"), rest.alias("rest"), keep.alias("keep"))
    rows = cut(latest(rows, ["file_id", "idx"], "ingested_at", ["start_sec", "end_sec", "key", "mark", "sure", "rest", "keep"]), "utterances")
    clock = repaired_clock(rows.select("file_id", "idx", "start_sec", "end_sec"))
    rows = rows.select("file_id", "idx", "start_sec", "key", "mark", "sure", "rest", "keep").join(clock.hint("merge"), ["file_id", "idx"])

    keys = speaker_keys(speakers).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    # the planner can't see that the keys are many times the table of speakers, and would broadcast them
    by = lambda name, out: keys.select("file_id", "salt", F.col("key").alias(name), F.col("label").alias(out)).hint("merge")
    rows = rows.withColumn("salt", F.pmod(F.col("idx"), F.lit(salt)))
    # a missing mark must not send all its rows to one task: it gets a key that no speaker has
    rows = rows.withColumn("mark", F.coalesce("mark", F.concat(F.lit("~"), F.col("idx").cast("string"))))
    rows = rows.withColumn("key", F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("~"), F.col("idx").cast("string"))))
    rows = rows.join(by("key", "told"), ["file_id", "salt", "key"], "left").join(by("mark", "marked"), ["file_id", "salt", "mark"], "left")
    text = F.when(F.col("sure") | F.col("marked").isNotNull(), F.col("rest")).otherwise(F.col("keep"))
    rows = rows.withColumn("text", text).where("text <> ''")
    rows = rows.withColumn("label", F.coalesce("told", "marked", F.lit(UNKNOWN)))
    at = F.coalesce(F.when(~F.isnan("start_sec"), F.col("start_sec")), "fixed_start", F.lit(0.0))
    return rows.select("file_id", "idx", "segment", F.coalesce("level", F.lit(0.0)).alias("level"), at.alias("at"), "label", "fixed_start", "fixed_end", "text")


ORDER = ["segment", "level", "at", "idx"]


def with_turns(rows: DataFrame, *, shard_sec: float = 600.0) -> DataFrame:
    """Add ``turn``, the number of the turn in its recording, to labelled utterances (file_id, label, and ORDER).

    A turn is a longest run of one label in that order. Changes of speaker are counted within shards of
    time; one row per shard carries the count and the last label on to the next, so a recording is worked on by as many
    tasks as it has shards.
    """
    rows = rows.withColumn("shard", F.struct("segment", F.floor(F.col("level") / F.lit(shard_sec)).cast("long").alias("n")))
    order = Window.partitionBy("file_id", "shard").orderBy(*ORDER)
    changed = F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("changed", changed)
    place = F.struct(*ORDER)
    shards = rows.groupBy("file_id", "shard").agg(
        F.min_by("label", place).alias("first_label"), F.max_by("label", place).alias("last_label"), F.sum("changed").alias("inner")
    )
    along = Window.partitionBy("file_id").orderBy("shard")
    shards = shards.withColumn("new", F.coalesce((F.col("first_label") != F.lag("last_label").over(along)).cast("long"), F.lit(1)))
    before = F.coalesce(F.sum(F.col("new") + F.col("inner")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("file_id", "shard", (before + F.col("new")).alias("base"))
    inside = F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(shards, ["file_id", "shard"]).withColumn("turn", F.col("base") + inside).drop("changed", "base")


def speaker_turns(rows: DataFrame) -> DataFrame:
    """One row per turn of the rows of ``with_turns``: its first and last utterance, label, repaired times and size."""
    place = F.struct(*ORDER)
    return rows.groupBy("file_id", "turn").agg(
        F.min_by("idx", place).alias("first_idx"),
        F.max_by("idx", place).alias("last_idx"),
        F.min("label").alias("label"),
        F.min("fixed_start").alias("start_sec"),
        F.max("fixed_end").alias("end_sec"),
        F.count(F.lit(1)).alias("n_utterances"),
    )


def turn_texts(rows: DataFrame) -> DataFrame:
    """The cleaned words of each turn, in one row per turn and shard of time, so that no turn is too long for a row."""
    said = F.array_sort(F.collect_list(F.struct(*ORDER, "text")))
    parts = rows.groupBy("file_id", "turn", "label", "shard").agg(said.alias("s"))
    part = F.row_number().over(Window.partitionBy("file_id", "turn").orderBy("shard")) - 1
    return parts.select("file_id", "turn", part.alias("part"), "label", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
