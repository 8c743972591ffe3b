"""The library of recordings: what is there, what is being worked on, adding and removing."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut


def listing(manifest: DataFrame, audio: DataFrame, jobs: DataFrame) -> DataFrame:
    """(file_id, title, duration, status) of every recording of the ``manifest`` (file_id, title), then of unknown jobs.

    The status of a running job (file_id, title, status) comes first, then 'ready' if the recording is indexed.
    """
    a = audio.select("file_id", F.col("duration_sec").alias("duration"), F.lit(True).alias("__indexed"))
    j = jobs.select("file_id", F.col("status").alias("__job"))
    status = F.coalesce("__job", F.when(F.col("__indexed"), "ready").otherwise("not indexed"))
    known = manifest.select("file_id", F.coalesce("title", "file_id").alias("title")).join(a, "file_id", "left").join(j, "file_id", "left")
    known = known.select("file_id", "title", "duration", status.alias("status"))
    other = jobs.join(manifest.select("file_id"), "file_id", "left_anti")
    return known.unionByName(other.select("file_id", "title", F.lit(None).cast("double").alias("duration"), "status"))


def duplicate_ids(manifest: DataFrame) -> DataFrame:
    """The ids that a manifest lists more than once."""
    return manifest.groupBy("file_id").count().where("count > 1").select("file_id")


def differs(a: DataFrame, b: DataFrame, column: str = "file_id") -> DataFrame:
    """(column, missing_in): the ids that only one of two tables has; empty if both hold the same set."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    only = lambda p, q, name: p.join(q, column, "left_anti").withColumn("missing_in", F.lit(name))
    return only(x, y, "second").unionByName(only(y, x, "first"))


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the recordings ``gone`` (file_id): a removal that cascades."""
    ids = cut(gone.select("file_id").distinct(), "gone")
    return {name: df.join(ids, "file_id", "left_anti") for name, df in tables.items()}


def not_built(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """The recordings still to be worked on."""
    return wanted.join(built.select("file_id"), "file_id", "left_anti")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``child`` whose key no row of ``parent`` has."""
    return child.join(parent.select(*keys), keys, "left_anti")


def new_file_id(filename: str, taken: Iterable[str]) -> str:
    """A safe id for a file name that is not yet taken; later ones of the same name get a number."""
    stem = Path(filename.rsplit("/", 1)[-1]).stem.lower()
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in stem)
    base = "_".join(kept.split())[:48] or "recording"
    used = set(taken)
    return next(x for n in range(1, len(used) + 2) if (x := base if n == 1 else f"{base}_{n}") not in used)


class Busy(RuntimeError):
    """The recording has a change in progress."""


class Library:
    """The state of a library's changes: ids and titles of its manifest, and the jobs not finished yet."""

    def __init__(self, manifest: dict[str, str]):
        self.manifest = dict(manifest)
        self.jobs: dict[str, dict[str, str]] = {}

    def add(self, filename: str, title: str | None, work) -> str:
        """Queue a new recording and run ``work(file_id, tell)``; a failure stays visible as the job's status."""
        fid = new_file_id(filename, {*self.manifest, *self.jobs})
        self.jobs[fid] = {"title": title or Path(filename).stem, "status": "queued"}
        try:
            work(fid, lambda status: self.jobs[fid].update(status=status))
            self.manifest[fid] = self.jobs.pop(fid)["title"]
        except Exception as e:  # noqa: BLE001 - shown to the user
            self.jobs[fid]["status"] = f"failed: {e}"
        return fid

    def remove(self, fid: str, work) -> None:
        """Forget a failed job, or take a recording out of the manifest and run ``work(file_id)``."""
        job = self.jobs.get(fid)
        if job and job["status"].startswith("failed"):
            del self.jobs[fid]
            return
        if job:
            raise Busy(f"{fid} is busy: {job['status']}")
        if fid not in self.manifest:
            raise LookupError(fid)
        self.jobs[fid] = {"title": self.manifest[fid], "status": "removing"}
        try:
            title = self.manifest.pop(fid)
            work(fid)
            del self.jobs[fid]
        except Exception as e:  # noqa: BLE001
            self.jobs[fid] = {"title": title, "status": f"failed: {e}"}
