"""The tables of a folder by key: rows that repeat a key count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.operators.versions import latest
from earshot.sources.tables import table


def chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "chunks"), ["id"], "ingested_at", list(columns))


def utterances(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "utterances"), ["file_id", "idx"], "ingested_at", list(columns))


def hits(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "hits"), ["hit_id"], "logged_at", list(columns))


def audio_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "audio_files"), ["file_id"], "ingested_at", list(columns))


def speakers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "speakers").select("file_id", "label", "role", "name").distinct()


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "queries")
