"""Row numbers, running sums and other measures along an order, over groups of any size.

A window partitioned by the group alone would put a hot group into one task. Here the rows are range-partitioned by
(group, order), so a hot group spreads over many tasks; each task works along its own rows, and what the tasks before (or
after) it found for the group is carried in as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import cut

PART = "__part"


@dataclass(frozen=True)
class Along:
    """A measure along an order: 'sum', 'max' or 'min' of ``value``, or 'last', its nearest value that is not null.

    ``inclusive``: whether the row itself counts. ``backward``: over the rows that follow instead of those before.
    """

    how: str
    value: Column
    inclusive: bool = True
    backward: bool = False


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "placed") -> DataFrame:
    """``df`` range-partitioned by keys and order and written once, with the number of its part: the placement is then fixed."""
    if PART in df.columns:
        raise ValueError(f"reserved column name: {PART}")
    rows = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
    return cut(rows.withColumn(PART, F.spark_partition_id()), name)


def carried(rows: DataFrame, keys: list[str], order: list[str], outs: dict[str, Along]) -> DataFrame:
    """Add the measures ``outs`` to the rows of ``placed``, each along ``order`` (ascending, total) within ``keys``.

    A sum over no rows is 0, any other measure over no rows null. ``keys`` must not be null.
    """
    taken = {f"__{x}_{n}" for x in ("v", "c") for n in outs} & set(rows.columns)
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")
    rows = rows.withColumns({f"__v_{n}": o.value for n, o in outs.items()})
    whole = {"sum": F.sum, "max": F.max, "min": F.min}
    # one row per group and part: at most (number of parts) rows for any group
    parts, place = [], F.struct(*order)
    for n, o in outs.items():
        v = F.col(f"__v_{n}")
        by = F.when(v.isNotNull(), place)
        parts.append((whole[o.how](v) if o.how in whole else (F.min_by if o.backward else F.max_by)(v, by)).alias(f"__v_{n}"))
    sums = rows.groupBy(*keys, PART).agg(*parts)
    carries = []
    for n, o in outs.items():
        others = Window.partitionBy(*keys).orderBy(F.col(PART).desc() if o.backward else F.col(PART)).rowsBetween(Window.unboundedPreceding, -1)
        v = F.col(f"__v_{n}")
        carries.append((whole[o.how](v) if o.how in whole else F.last(v, ignorenulls=True)).over(others).alias(f"__c_{n}"))
    rows = rows.join(sums.select(*keys, PART, *carries), [*keys, PART])
    found = {}
    for n, o in outs.items():
        line = [F.col(c).desc() if o.backward else F.col(c).asc() for c in order]
        inside = Window.partitionBy(*keys, PART).orderBy(*line).rowsBetween(Window.unboundedPreceding, 0 if o.inclusive else -1)
        v, c = F.col(f"__v_{n}"), F.col(f"__c_{n}")
        here = (whole[o.how](v) if o.how in whole else F.last(v, ignorenulls=True)).over(inside)
        if o.how == "sum":
            found[n] = F.coalesce(c, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            found[n] = F.coalesce(here, c) if o.how == "last" else (F.greatest if o.how == "max" else F.least)(here, c)
    return rows.withColumns(found).drop(*[f"__{x}_{n}" for x in ("v", "c") for n in outs])


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str, name: str = "running"
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same ``keys`` up to and including this one.

    ``order`` must be total within ``keys``; ``keys`` must not be null. An empty table stays empty. The bounds of the
    ranges are fixed by writing the placed rows once, so both uses below see the same placement.
    """
    clash = {PART, "__amount", "__before"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    rows = placed(df.withColumn("__amount", amount), keys, order, name)
    # one row per group and task: at most (number of tasks) rows for any group
    sums = rows.groupBy(*keys, PART).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, PART, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(sums, [*keys, PART])
        .withColumn(out, F.col("__before") + F.sum("__amount").over(inside))
        .drop(PART, "__amount", "__before")
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str, name: str = "numbers") -> DataFrame:
    """Add ``out``: the place, from 1, of each row among the rows of the same ``keys`` in ``order`` (which must be total)."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, name)
