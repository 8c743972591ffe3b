"""Nested documents: transcripts and recognition responses as JSON, manifests and labels as YAML, audio as samples."""

from __future__ import annotations

import io
import json
import wave
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<tok:string,start_sec:double,end_sec:double>"
TRANSCRIPT = (
    "file_id string, duration double, "
    f"utterances array<struct<idx:int,speaker:string,start_sec:double,end_sec:double,text:string,words:array<{WORD}>>>, "
    "speakers array<struct<label:string,role:string,name:string,confidence:double,n_words:bigint,question_rate:double>>"
)
RESPONSE = "text string, words array<struct<word:string,start:double,end:double>>, segments array<struct<end:double>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents, one per file; the schema is stated, so nothing is read twice to guess it."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """One JSON document per line, UTF-8 as it is."""
    transcripts.write.json(path)


def transcript_tables(transcripts: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of nested transcripts."""
    return {
        "audio_files": transcripts.select("file_id", F.col("file_id").alias("title"), F.col("duration").alias("duration_sec")),
        "utterances": transcripts.select("file_id", F.inline("utterances")),
        "speakers": transcripts.select("file_id", F.inline("speakers")),
    }


def nested(utterances: DataFrame, speakers: DataFrame, audio: DataFrame) -> DataFrame:
    """Transcript documents from flat tables, the utterances in order."""
    u = F.array_sort(F.collect_list(F.struct("idx", "speaker", "start_sec", "end_sec", "text", "words")))
    utt = utterances.groupBy("file_id").agg(u.alias("utterances"))
    spk = speakers.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("label", "role", "name", "confidence", "n_words", "question_rate"))).alias("speakers"))
    rows = audio.select("file_id", F.col("duration_sec").alias("duration")).join(utt, "file_id", "left").join(spk, "file_id", "left")
    return rows.select("file_id", "duration", F.coalesce("utterances", F.array()).alias("utterances"), F.coalesce("speakers", F.array()).alias("speakers"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Cached recognition responses, named by their file."""
    rows = spark.read.schema(RESPONSE).option("multiLine", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[a-z]+)?\.json$", 1)
    return rows.select(name.alias("file_id"), "text", "words", "segments")


def recognise(wanted: DataFrame, cached: DataFrame, client=None) -> DataFrame:
    """Responses for the recordings ``wanted`` (file_id, path): those cached, and the others from ``client(path) -> dict``.

    Without a client a recording that is not cached is an error when it is reached; nothing is called for cached ones.
    """
    have = cached.join(wanted.select("file_id"), "file_id", "left_semi")
    missing = wanted.join(cached.select("file_id"), "file_id", "left_anti").select("file_id", "path")

    def call(batches):
        for pdf in batches:
            for fid, path in zip(pdf["file_id"], pdf["path"]):
                if client is None:
                    raise RuntimeError(f"{fid} is not cached and no recogniser is set")
                r = client(path)
                yield pd.DataFrame({"file_id": [fid], "text": [r.get("text", "")], "words": [r.get("words", [])], "segments": [r.get("segments", [])]})

    return have.unionByName(missing.mapInPandas(call, f"file_id string, {RESPONSE}"))


def read_audio(spark: SparkSession, path: str, *, rate: int = 16_000, decode=None) -> DataFrame:
    """(file_id, samples): mono samples from -1 to 1 at ``rate``; ``decode(bytes) -> (rate, channels x n)`` for other forms than WAV."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)

    def run(batches):
        for pdf in batches:
            rows = []
            for fid, data in zip(pdf["file_id"], pdf["content"]):
                sr, x = (decode or wav_samples)(bytes(data))
                x = resampled(np.atleast_2d(x).mean(0), sr, rate)
                rows.append((fid, x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["file_id", "samples"])

    return files.select(name.alias("file_id"), "content").mapInPandas(run, "file_id string, samples array<float>")


def resampled(x: np.ndarray, rate: int, to: int, *, reach: int = 16) -> np.ndarray:
    """Samples at another rate: each new one is a windowed sinc over ``reach`` old ones to either side, cut off at the lower rate's half."""
    if rate == to or not len(x):
        return x
    low = min(1.0, to / rate)
    wide = int(np.ceil(reach / low))
    padded = np.concatenate([np.zeros(wide), x, np.zeros(wide)])
    out = []
    for a in range(0, round(len(x) * to / rate), 1 << 14):
        at = np.arange(a, min(a + (1 << 14), round(len(x) * to / rate))) * rate / to
        first = np.floor(at).astype(int)
        near = first[:, None] + np.arange(-wide + 1, wide + 1)
        off = at[:, None] - near
        weight = low * np.sinc(low * off) * np.cos(np.pi * np.clip(off / wide, -1, 1) / 2) ** 2
        out.append((padded[near + wide] * weight).sum(1))
    return np.concatenate(out)


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """The rate and the samples, channels x n from -1 to 1, of a WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        if width == 1:  # the only width without a sign
            x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = (b[:, 0] | b[:, 1] << 8 | b[:, 2].astype(np.int8).astype(np.int32) << 16).astype(np.float64)
        else:
            x = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float64)
        return w.getframerate(), (x / 2 ** (8 * width - 1)).reshape(-1, w.getnchannels()).T


def _yaml():
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML needs the yaml package") from e
    return yaml


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, title, host, guest) of a manifest; an id listed twice is an error, a missing title is the id."""
    raw = _yaml().safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows, seen = [], set()
    for item in raw.get("files") or []:
        fid = str(item["file_id"])
        if fid in seen:
            raise ValueError(f"the manifest lists {fid} twice")
        seen.add(fid)
        who = item.get("speakers") or {}
        rows.append((fid, str(item.get("title", fid)), who.get("host"), who.get("guest")))
    return spark.createDataFrame(rows, "file_id string, title string, host string, guest string")


def edit_manifest(path: str, edit) -> None:
    """Rewrite a manifest by ``edit(data)``; the comment lines at its head stay as they are."""
    yaml, file = _yaml(), Path(path)
    lines = file.read_text(encoding="utf-8").splitlines(keepends=True)
    n = next((i for i, line in enumerate(lines) if not line.startswith("#")), len(lines))
    data = yaml.safe_load("".join(lines)) or {}
    edit(data)
    file.write_text("".join(lines[:n]) + yaml.safe_dump(data, sort_keys=False, allow_unicode=True, width=100), encoding="utf-8")


def read_labelled_queries(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """Queries with their labelled intervals, and the tolerance in seconds."""
    raw = _yaml().safe_load(Path(path).read_text(encoding="utf-8"))
    rows = [
        (q["id"], q["query"], q.get("category"), q.get("split"), q.get("role"), q.get("notes"),
         [(r["file"], float(r["start"]), float(r["end"]), int(r["grade"]), r.get("quote")) for r in q.get("relevant") or []])
        for q in raw["queries"]
    ]
    kinds = "query_id string, query_text string, category string, split string, role string, notes string, relevant array<struct<file_id:string,start_sec:double,end_sec:double,grade:int,quote:string>>"
    return spark.createDataFrame(rows, kinds), float(raw.get("tolerance_sec", 5.0))


def write_labelled_queries(queries: DataFrame, path: str, header: str = "# Written by a program; changes made here are lost.\n", tolerance_sec: float = 5.0) -> None:
    """The labelled queries as YAML under a comment line. A label set is written by hand, so it fits the driver."""
    out = []
    for q in queries.orderBy("query_id").toLocalIterator():
        item = {"id": q.query_id, "query": q.query_text, "category": q.category, "split": q.split}
        item |= {k: v for k, v in (("role", q.role), ("notes", q.notes)) if v}
        item["relevant"] = [{"file": r.file_id, "start": r.start_sec, "end": r.end_sec, "grade": r.grade, "quote": r.quote} for r in q.relevant or []]
        out.append(item)
    body = {"tolerance_sec": tolerance_sec, "queries": out}
    Path(path).write_text(header + _yaml().safe_dump(body, sort_keys=False, allow_unicode=True, width=100), encoding="utf-8")


def hits_as_json(hits: DataFrame, *, keys: list[str]) -> DataFrame:
    """(*keys, json): each hit as the search service would send it, with its time as MM:SS.s; ``keys`` are not sent, nulls are."""
    from earshot.functions.text import minutes

    body = F.to_json(F.struct(*[c for c in hits.columns if c not in keys], minutes(F.col("start_sec")).alias("timestamp")), {"ignoreNullFields": "false"})
    return hits.select(*keys, body.alias("json"))


def land(folder: str, name: str, data: bytes, *, most_bytes: int = 200 * 1024 * 1024) -> Path:
    """Put an uploaded file into the landing folder; empty or oversized ones are refused."""
    if not data:
        raise ValueError("empty upload")
    if len(data) > most_bytes:
        raise OverflowError("upload too large")
    target = Path(folder) / Path(name).name
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_bytes(data)
    part.rename(target)  # streams see whole files only
    return target


def to_json(rows: DataFrame) -> list[dict]:
    return [json.loads(r) for r in rows.toJSON().collect()]
