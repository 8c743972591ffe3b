"""From recordings to transcripts and on to the index: who speaks, utterances, roles, documents, and what has to be rebuilt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import diarization, library, segments
from earshot.operators.models import VoiceEncoder
from earshot.session import cut, tidy
from earshot.sources import transcripts
from earshot.sources.store import Store

RATE = 16_000


def seconds_of(audio: DataFrame, *, rate: int = RATE) -> DataFrame:
    """(file_id, second, samples): recordings (file_id, samples) in rows of one second, so that no later row is long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fid, x in zip(pdf["file_id"], pdf["samples"]):
                parts = [x[a : a + rate] for a in range(0, len(x), rate)]
                yield pd.DataFrame({"file_id": fid, "second": np.arange(len(parts), dtype=np.int32), "samples": parts})

    return audio.select("file_id", "samples").mapInPandas(run, "file_id string, second int, samples array<float>")


def voice_vectors(windows: DataFrame, seconds: DataFrame, make: Callable[[], VoiceEncoder], *, size_sec: float = 1.5, rate: int = RATE, batch: int = 64) -> DataFrame:
    """(file_id, n, start_sec, end_sec, embedding) of windows (file_id, n, start_sec, end_sec), whose samples are filled up to one length with silence."""
    last = F.greatest(F.floor("start_sec"), F.ceil("end_sec") - 1).cast("int")
    asked = windows.withColumn("second", F.explode(F.sequence(F.floor("start_sec").cast("int"), last)))
    rows = asked.join(seconds, ["file_id", "second"], "left").groupBy("file_id", "n", "start_sec", "end_sec")
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("second", "samples"))).alias("parts"))
    size = round(size_sec * rate)

    def wave(start: float, end: float, parts) -> np.ndarray:
        out, first = np.zeros(size, np.float32), int(start)
        for p in parts:
            at = round((p["second"] - start) * rate)
            x = np.asarray(p["samples"] if p["samples"] is not None else [], np.float32)[max(0, -at) :]
            at = max(0, at)
            stop = min(size, round((end - start) * rate), at + len(x))
            out[at:stop] = x[: max(0, stop - at)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            waves = [wave(s, e, p) for s, e, p in zip(pdf["start_sec"], pdf["end_sec"], pdf["parts"])]
            found = [v for a in range(0, len(waves), batch) for v in np.asarray(model.encode(np.stack(waves[a : a + batch])))]
            yield pdf.drop(columns="parts").assign(embedding=[v.astype(np.float64) for v in found])

    return rows.mapInPandas(run, "file_id string, n int, start_sec double, end_sec double, embedding array<double>")


def speakers_of(words: DataFrame, voices: DataFrame, segment_ends: DataFrame | None = None) -> DataFrame:
    """Words (file_id, idx, text, start_sec, end_sec) with ``speaker``: from voices (file_id, n, start_sec, end_sec, embedding) to the best path.

    Voices are clustered in two, windows spread over frames, frames gathered under words; the cheapest sequence of changes
    decides, and who speaks first is SPEAKER_00.
    """
    spark = words.sparkSession
    words = cut(words.select("file_id", "idx", "text", "start_sec", "end_sec"), "diarised-words")
    voices = cut(diarization.window_posteriors(voices), "posteriors")
    tidy(spark)
    free = segments.boundaries(words, segment_ends).select("file_id", "idx", "start_sec", "end_sec", "boundary")
    like = segments.heard(free, voices)
    like = like.withColumns({c: F.round(c, 9) for c in ("l0", "l1")})  # so that no tie is decided by the last digit of a sum
    tidy(spark)
    path = cut(segments.viterbi(like), "paths")
    tidy(spark)
    named = segments.first_speaker(path).select("file_id", "idx", F.col("label").alias("speaker"))
    return words.join(named, ["file_id", "idx"])


def numbered_windows(words: DataFrame) -> DataFrame:
    """The windows over all speech of each recording, numbered along it."""
    w = segments.sliding_windows(segments.speech_regions(words))
    return segments.row_numbers(w.drop("n"), ["file_id"], [F.col("region").asc(), F.col("start_sec").asc(), F.col("end_sec").asc()], "k", "windows").select(
        "file_id", F.col("k").cast("int").alias("n"), "start_sec", "end_sec"
    )


def build_transcripts(responses: DataFrame, audio: DataFrame, make: Callable[[], VoiceEncoder], names: DataFrame | None = None) -> DataFrame:
    """Transcript documents of recordings from what was recognised (file_id, text, words, segments) and their samples (file_id, samples)."""
    aligned = cut(segments.aligned(responses), "aligned")
    seconds = cut(seconds_of(audio), "seconds")
    voices = cut(voice_vectors(numbered_windows(aligned), seconds, make), "voices")
    words = speakers_of(aligned, voices, aligned.where("ends_segment").select("file_id", "idx"))
    utterances = cut(segments.build_utterances(words), "utterances")
    length = seconds.groupBy("file_id").agg((F.sum(F.size("samples")) / RATE).alias("duration_sec"))
    return transcripts.nested(utterances, segments.roles(utterances, names), length)


def rebuild_if_needed(spark: SparkSession, folder: str, manifest: DataFrame, build: Callable[[], dict[str, DataFrame]]) -> bool:
    """Build the index in ``folder`` anew if there is none or if its recordings are not those of the manifest (file_id); whether it was."""
    store = Store(spark, folder)
    if store.current() is not None and library.differs(store.read("audio_files"), manifest).isEmpty():
        return False
    store.rebuild(build())
    return True
