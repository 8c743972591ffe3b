"""Continuous periods and the gaps between them, from intervals that overlap, nest, touch or pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times beyond this many seconds (about 285 years) are taken for damage.
FARTHEST_SEC = 9.0e9


def _keys(keys: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def periods_and_gaps(
    df: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    *,
    join_ms: int = 500,
    sitting_ms: int = 3_600_000,
    shard_ms: int = 600_000,
) -> DataFrame:
    """Rows (keys, kind 'period' or 'gap', start_ms, end_ms), all times rounded to milliseconds.

    Intervals of one entity that overlap, touch or lie at most ``join_ms`` apart belong to one period. A gap runs from
    the end of a period to the start of the next; if they are more than ``sitting_ms`` apart no gap is listed.

    The merge has two levels. Time is cut into shards; the intervals of one entity that start in one shard are merged
    there, clipped to the time up to the next shard in use, and what earlier shards carry over is added. Only merged
    pieces within ``join_ms`` of such a boundary (two per shard at most) meet in the second level, where they are
    stitched. So an entity that holds a third of all rows is merged by as many tasks as it has shards, and no interval,
    however long, is expanded.

    Null key: the row is left out. Null, NaN or absurd times, or an end not after the start: left out. Repeated rows and
    ties change nothing. Empty table: empty result. Other columns, whatever their names, are ignored.
    """
    ks = _keys(keys)
    s, e = F.col(f"`{start}`").cast("double"), F.col(f"`{end}`").cast("double")
    sane = (F.abs(s) < FARTHEST_SEC) & (F.abs(e) < FARTHEST_SEC) & (e > s) & ~F.isnan(s) & ~F.isnan(e)
    named = [F.col(f"`{k}`").isNotNull() for k in keys]
    rows = df.where(sane)
    for n in named:
        rows = rows.where(n)
    rows = rows.select(
        *[F.col(f"`{k}`").alias(x) for k, x in zip(keys, ks)],
        F.round(s * 1000).cast("long").alias("s"),
        F.round(e * 1000).cast("long").alias("e"),
    )
    k_of = F.floor(F.col("s") / F.lit(shard_ms)).cast("long")
    # at most shard_ms distinct starts are left in a shard of an entity, however many rows there were
    rows = rows.groupBy(*ks, "s").agg(F.max("e").alias("e")).withColumn("k", k_of)

    # the shards in use of an entity: where the next one begins, and how far earlier ones reach
    along = Window.partitionBy(*ks).orderBy("k")
    shards = rows.groupBy(*ks, "k").agg(F.max("e").alias("reach"))
    shards = shards.select(
        *ks,
        "k",
        (F.lead("k").over(along) * F.lit(shard_ms)).alias("next_ms"),
        F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    )
    clip = lambda c: F.least(c, F.col("next_ms"))  # noqa: E731 - least() skips the null of the last shard
    begin = F.col("k") * F.lit(shard_ms)
    columns = [*ks, "k", "next_ms"]
    pieces = rows.join(shards, [*ks, "k"]).select(*columns, "s", clip(F.col("e")).alias("e"))
    carried = shards.where(F.col("carried") > begin).select(*columns, begin.alias("s"), clip(F.col("carried")).alias("e"))
    local = _merge(pieces.unionByName(carried), [*ks, "k", "next_ms"], join_ms)

    near = (F.col("s") <= begin + join_ms) | (F.col("e") >= F.col("next_ms") - join_ms)
    local = local.withColumn("edge", F.coalesce(near, F.lit(False)))
    stitched = _merge(local.where("edge").select(*ks, "s", "e"), ks, join_ms)
    periods = local.where("not edge").select(*ks, "s", "e").unionByName(stitched).withColumn("k", k_of)

    # the start of the next period: within the shard, else the first of the next shard in use
    first = periods.groupBy(*ks, "k").agg(F.min("s").alias("first_s"))
    first = first.select(*ks, "k", F.lead("first_s").over(along).alias("after"))
    inside = F.lead("s").over(Window.partitionBy(*ks, "k").orderBy("s"))
    periods = periods.withColumn("then", inside).join(first, [*ks, "k"]).withColumn("then", F.coalesce("then", "after"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("then").alias("end_ms")),
    )
    out = periods.select(*ks, F.inline(both))
    pause = F.col("end_ms") - F.col("start_ms")
    out = out.where((F.col("kind") == "period") | (F.col("end_ms").isNotNull() & (pause <= sitting_ms)))
    return out.select(*[F.col(x).alias(k) for k, x in zip(keys, ks)], "kind", "start_ms", "end_ms")


def _merge(df: DataFrame, keys: list[str], join_ms: int) -> DataFrame:
    """Merge the rows (s, e) of each key by the running maximum of e."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("s") <= reach + join_ms, 0).otherwise(1)
    marked = df.withColumn("new", new)
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")
