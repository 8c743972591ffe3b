"""Indexes that are built once per application, and again when the tables they rest on change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.session import owned, release, tidy, written
from earshot.sources.store import Store, folder_state

_KNOWN: dict[tuple[str, str, str], tuple[tuple, str, str, list[str]]] = {}


def published(spark: SparkSession, name: str, folder: str, sources: tuple[str, ...], build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that ``build`` makes of the tables ``sources`` of a folder, as written; all of one version."""
    known = (spark.sparkContext.applicationId, name, folder)
    state = tuple(folder_state(spark, f"{folder}/{n}.parquet") for n in sources)
    if known not in _KNOWN or _KNOWN[known][0] != state:
        place, steps = owned(spark, name, lasting=True), written()
        tables = build()
        _KNOWN[known] = (state, place, Store(spark, place).rebuild(tables), list(tables))
        del tables
        release(spark, steps)  # what was written on the way
        tidy(spark)
    _, place, version, names = _KNOWN[known]
    return {n: Store(spark, place).read(n, version) for n in names}
