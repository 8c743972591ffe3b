"""An index of several tables that changes as one: versions in folders, and a pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from earshot.session import together


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` in the place of a small file at once: readers see the old one or the new one, never a part."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    fs = target.getFileSystem(conf)
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, target, options)


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder, in the place of what was there; nothing happens if there is none."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(a):
        fs.mkdirs(b.getParent())
        fs.delete(b, True)
        fs.rename(a, b)


def folder_state(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder from another: names, sizes and times of change."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target))) if fs.exists(target) else ()


class Store:
    """Tables under ``folder``: each rebuild is a new version, visible to readers only once the pointer names it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> str | None:
        text = read_file(self.spark, f"{self.folder}/CURRENT")
        return text and text.strip()

    def rebuild(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> str:
        """Write all ``tables`` as a new version, then move the pointer; a failure before that leaves the old version."""
        version = uuid.uuid4().hex

        def write(name: str, df: DataFrame) -> None:
            # an index is written once and lasts; vectors of words that return take a fraction of their bytes
            writer = df.write.mode("errorifexists").option("compression", "zstd")
            if partition_by and name in partition_by:
                writer = writer.partitionBy(*partition_by[name])
            writer.parquet(f"{self.folder}/{version}/{name}")

        together(*[lambda n=n, df=df: write(n, df) for n, df in tables.items()])
        replace_file(self.spark, f"{self.folder}/CURRENT", version)
        return version

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """A table of the current version, or of the one named (which a query resolves once, for all its tables)."""
        version = version or self.current()
        if version is None:
            raise LookupError(f"no index in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def counts(self, names: list[str]) -> dict[str, int]:
        version = self.current()
        return {n: self.read(n, version).count() for n in names}
