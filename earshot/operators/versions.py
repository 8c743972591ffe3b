"""Rows that repeat a key: the latest one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """One row per key with ``columns`` of the row whose ``version`` is greatest.

    Ties and null versions: a null version counts as oldest; between equal versions the larger row wins, so the result
    does not depend on the order of the input. Null keys form a key of their own. Partial aggregation keeps a key that
    repeats millions of times from travelling.
    """
    best = F.max(F.struct(F.col(version).alias("__v"), *[F.col(c) for c in columns])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
