"""The text functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from earshot.functions.phonetics import double_metaphone, metaphone, stem

NAMES = ("english_stem", "metaphone", "dmetaphone", "dmetaphone_alt")


def _by_word(work):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else work(x))

    return run


def register(spark: SparkSession) -> tuple[str, ...]:
    """Register stemmer and sound codes in a session; null in, null out. Returns the names."""
    for name, work in zip(NAMES, (stem, metaphone, lambda w: double_metaphone(w)[0], lambda w: double_metaphone(w)[1])):
        spark.udf.register(name, _by_word(work))
    return NAMES
