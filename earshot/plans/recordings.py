"""A library of recordings in a folder: uploads become transcripts and an index, removals leave both."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import library
from earshot.operators.models import VoiceEncoder
from earshot.plans import ingest, search
from earshot.sources import transcripts
from earshot.sources.store import Store, delete_folder, list_folder, move_folder, read_file, replace_file


class Recordings:
    """Recordings under ``folder`` (a path that all executors see): audio, transcripts, a list of titles and the index.

    ``recognise(path)`` gives what is said in a file, ``make`` builds the encoder of voices, ``decode`` reads other audio than
    WAV. A recording is added or removed whole: what fails stays visible as the status of its job, and its files go.
    """

    TABLES = ("audio_files", "speakers", "utterances", "passages", "late_vectors", "postings", "stems", "vocabulary")

    def __init__(self, spark: SparkSession, folder: str, recognise: Callable[[str], dict], make: Callable[[], VoiceEncoder], *, decode=None, **index):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.recognise, self.make, self.decode, self.options = recognise, make, decode, index
        self.library = library.Library(json.loads(read_file(spark, self._at("titles.json")) or "{}"))

    def _at(self, name: str) -> str:
        return f"file://{self.folder}/{name}"

    def add(self, filename: str, data: bytes, title: str | None = None) -> str:
        """Take in an uploaded file: its id. Empty or oversized files are refused."""
        landed = transcripts.land(f"{self.folder}/landing", filename, data)

        def work(fid: str, tell: Callable[[str], None]) -> None:
            audio = f"{self.folder}/audio/{fid}/{fid}{landed.suffix}"
            try:
                tell("transcribing")
                transcripts.land(f"{self.folder}/audio/{fid}", f"{fid}{landed.suffix}", data)
                wanted = self.spark.createDataFrame([(fid, audio)], "file_id string, path string")
                heard = transcripts.recognise(wanted, self.spark.createDataFrame([], f"file_id string, {transcripts.RESPONSE}"), self.recognise)
                samples = transcripts.read_audio(self.spark, f"file://{audio}", decode=self.decode)
                transcripts.write_transcripts(ingest.build_transcripts(heard, samples, self.make), self._at(f"transcripts/{fid}"))
                tell("indexing")
                self._save({**self.library.manifest, fid: title or landed.stem})
                self.start()
            except Exception:
                for part in (f"audio/{fid}", f"transcripts/{fid}"):
                    delete_folder(self.spark, self._at(part))
                self._save(self.library.manifest)
                raise
            finally:
                landed.unlink(missing_ok=True)

        return self.library.add(filename, title, work)

    def remove(self, fid: str) -> None:
        """Take a recording out; its files are moved aside, not deleted. A failed job is only forgotten."""

        def work(fid: str) -> None:
            self._save(self.library.manifest)
            for part in ("audio", "transcripts"):
                move_folder(self.spark, self._at(f"{part}/{fid}"), self._at(f"removed/{part}/{fid}"))
            self.start()

        self.library.remove(fid, work)

    def start(self) -> bool:
        """Build the index anew if it doesn't hold the recordings that are listed; whether it had to be."""
        listed = self.spark.createDataFrame(sorted(json.loads(read_file(self.spark, self._at("titles.json")) or "{}").items()), "file_id string, title string")
        return ingest.rebuild_if_needed(self.spark, self._at("index"), listed, lambda: self._tables(listed))

    def index(self) -> dict[str, DataFrame]:
        """The tables of the index, all of one version."""
        store = Store(self.spark, self._at("index"))
        version = store.current()
        return {n: store.read(n, version) for n in self.TABLES}

    def listing(self) -> list[tuple[str, str, float | None, str]]:
        """(file_id, title, duration, status) of every recording and every job."""
        frame = lambda rows, kinds: self.spark.createDataFrame(rows, kinds)
        jobs = frame([(f, j["title"], j["status"]) for f, j in self.library.jobs.items()], "file_id string, title string, status string")
        known = Store(self.spark, self._at("index")).current() is not None
        audio = self.index()["audio_files"] if known else frame([], "file_id string, duration_sec double")
        rows = library.listing(frame(list(self.library.manifest.items()), "file_id string, title string"), audio, jobs)
        return sorted(tuple(r) for r in rows.collect())

    def _save(self, titles: dict[str, str]) -> None:
        replace_file(self.spark, self._at("titles.json"), json.dumps(titles))

    def _tables(self, listed: DataFrame) -> dict[str, DataFrame]:
        have = list_folder(self.spark, self._at("transcripts"))
        paths = [self._at(f"transcripts/{f}") for f in have]
        reader = self.spark.read.schema(transcripts.TRANSCRIPT)
        docs = reader.json(paths) if paths else self.spark.createDataFrame([], transcripts.TRANSCRIPT)
        flat = transcripts.transcript_tables(docs.join(listed.select("file_id"), "file_id", "left_semi"))
        audio = flat["audio_files"].drop("title").join(listed, "file_id").select("file_id", F.coalesce("title", "file_id").alias("title"), "duration_sec")
        return search.build_index(audio, flat["speakers"], flat["utterances"], **self.options)
