"""Queries of problem 2: speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import turns
from earshot.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of each recording."""
    rows = turns.labelled_utterances(table(spark, folder, "utterances"), table(spark, folder, "speakers"))
    return turns.speaker_turns(turns.with_turns(rows)).select("file_id", "first_idx", "last_idx", "label")


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned words of each turn."""
    rows = turns.labelled_utterances(table(spark, folder, "utterances"), table(spark, folder, "speakers"))
    return turns.turn_texts(turns.with_turns(rows))


QUERIES = {"p2_found": p2_found, "p2_texts": p2_texts}
SQL: dict[str, str] = {}
