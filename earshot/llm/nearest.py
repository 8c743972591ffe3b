"""The nearest record in time of the same entity, by rings of doubled width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

US = 1_000_000


def _micros(c):
    """Seconds as whole microseconds: distances are then exact. Null, NaN and absurd times give null."""
    c = c.cast("double")
    return F.when(F.abs(c) < 9.0e9, F.round(c * US).cast("long"))


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str,
    left_time: str,
    right_time: str,
    right_id: str,
    tolerance_sec: float = 2.0,
    first_ring_sec: float = 0.25,
) -> DataFrame:
    """``left`` with ``right_id`` (and ``distance_us``) of the nearest record of ``right`` within the tolerance.

    Rows of ``left`` without one are left out; on equal distances the smallest ``right_id`` wins. Every distinct pair of
    entity and time of ``left`` looks into the three buckets around its own, of the width of the first ring. A candidate
    no farther away than that width is provably the nearest, since all records as near as it lie in the buckets searched.
    Times without such a candidate go on to buckets of twice the width, until the width has reached the tolerance.
    Each ring is written once; only what it leaves unresolved is joined again.

    Nulls: a null entity, time or id matches nothing. Repeated rows of ``right`` change nothing; repeated rows of
    ``left`` each get their answer. A hot entity is spread over its buckets, a hot moment is one distinct time.
    Empty tables give an empty result. Columns of ``right`` beside those named are ignored, so names may clash.
    """
    clash = {"__t", "__m", "distance_us"} & set(left.columns)
    if clash or right_id in left.columns:
        raise ValueError(f"left has reserved names: {sorted(clash) or right_id}")
    asked = left.withColumn("__t", _micros(F.col(left_time)))
    known = (
        right.select(F.col(entity).alias("ent"), _micros(F.col(right_time)).alias("rt"), F.col(right_id).alias("rid"))
        .where("ent is not null and rt is not null and rid is not null")
        .groupBy("ent", "rt")
        .agg(F.min("rid").alias("rid"))
    )
    known = cut(known, "nearest-right")
    tolerance, width = round(tolerance_sec * US), max(1, round(first_ring_sec * US))
    open_ = asked.select(F.col(entity).alias("ent"), F.col("__t").alias("lt"))
    open_ = open_.where("ent is not null and lt is not null").distinct()
    answered: list[DataFrame] = []
    while True:
        width = min(width, tolerance) if tolerance else 1
        bucket = lambda c, w=width: F.floor(F.col(c) / F.lit(w)).cast("long")
        seek = open_.withColumn("b", F.explode(F.array(*[bucket("lt") + F.lit(i) for i in (-1, 0, 1)])))
        gap = F.abs(F.col("rt") - F.col("lt"))
        best = F.min(F.when(gap <= width, F.struct(gap.alias("d"), F.col("rid")))).alias("m")
        ring = seek.join(known.withColumn("b", bucket("rt")), ["ent", "b"], "left").groupBy("ent", "lt").agg(best)
        ring = cut(ring, "nearest-ring")
        answered.append(ring.where("m is not null"))
        if width >= tolerance:
            break
        open_ = ring.where("m is null").select("ent", "lt")
        width *= 2
    found = answered[0]
    for more in answered[1:]:
        found = found.unionByName(more)
    found = found.select(F.col("ent").alias("__ent"), F.col("lt").alias("__t"), F.col("m").alias("__m"))
    joined = asked.withColumn("__ent", F.col(entity)).join(found, ["__ent", "__t"])
    return joined.select(*left.columns, F.col("__m.rid").alias(right_id), F.col("__m.d").alias("distance_us"))
