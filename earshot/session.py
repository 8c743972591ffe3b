"""What the operators need from the session: a shared folder for written tables, and nothing else."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is missing, a session whose executors all run in this process (master ``local``) gets a temporary
    folder, once per process. Any other session has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="earshot-"))
    return _LOCAL[0]


def owned(spark: SparkSession, name: str, *, lasting: bool = False) -> str:
    """A new folder in the shared one, deleted when the application ends; unless it is ``lasting``, by ``release`` too."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _WRITTEN.append(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here.

    The written table survives the loss of any executor and is read column by column afterwards. It is deleted when the
    application ends, or before that by ``release``.
    """
    path = owned(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``cut`` that nothing reads any more: what was made of them has been written itself."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)
        if df._written_to in _WRITTEN:
            _WRITTEN.remove(df._written_to)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark deletes them once the driver's JVM has collected what named them."""
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def together(*jobs: Callable[[], T]) -> list[T]:
    """The results of independent jobs, which run side by side: small ones share the executors instead of waiting for each other."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def written() -> int:
    """How many written tables there are, for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, but: int = 0) -> int:
    """Delete the tables written so far, ``but`` for so many first ones, once nothing reads them any more; returns how many there were.

    For a long-lived application: call it when the result of a query has been written.
    """
    n = len(_WRITTEN) - but
    while len(_WRITTEN) > but:
        _delete(spark, _WRITTEN.pop())
    return n
