"""One ranking from several scores of different scales: a Borda count over averaged ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.ranking import Along, carried, placed, row_numbers
from earshot.operators.search import if_small
from earshot.session import cut


def borda(scores: DataFrame, items: DataFrame, *, weights: dict[str, float] | None = None) -> DataFrame:
    """(group, item, penalty, place) from ``scores`` (group, item, metric, value; smaller is better) and ``items`` (group, item).

    Within a group and metric, items get competition ranks with averaged ties. Items without a value in a metric stand
    behind those that have one and share the middle of the remaining ranks. The weighted ranks are added up; the smallest
    sum comes first, the smaller item id among equals. A metric that no item of a group has changes nothing there.

    Null or NaN values count as missing, null groups or items are left out, repeated rows (equal group, item and metric)
    count once with the best value. Empty tables give an empty result. Hot groups: equal values are counted before they
    are ranked, and ranks and places are running sums over ranges, so a group with a third of all rows is spread out; what
    is one row per group is broadcast where it is known to be small, and items are joined to their ranks by value.
    """
    items = items.select("group", "item").where("group is not null and item is not null").distinct()
    value = F.col("value").cast("double")
    rows = scores.where(value.isNotNull() & ~F.isnan(value) & F.col("group").isNotNull() & F.col("item").isNotNull())
    rows = rows.groupBy("group", "item", "metric").agg(F.min(value).alias("value"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("metric") == name, F.lit(float(w))).otherwise(weight)

    counts = rows.groupBy("group", "metric", "value").agg(F.count(F.lit(1)).alias("c"))
    keys, order = ["group", "metric"], ["value"]
    ranks = placed(counts, keys, [F.col("value").asc()], "borda-ranks")
    # how many stand up to a value and how many behind it: their sum is the number of items that have one
    c = F.col("c")
    ranks = carried(ranks, keys, order, {"upto": Along("sum", c), "after": Along("sum", c, inclusive=False, backward=True)})
    have = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), "borda-counts")
    # one row per group: broadcast if they are few, else joined by sorting
    size = if_small(cut(items.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "borda-sizes"), 64)
    # the rank of a missing value is the same for a whole group and metric: added as an offset of the group
    absent = lambda m: (m + 1 + F.col("n")) / 2
    base = have.join(size, "group").groupBy("group").agg(F.sum(absent(F.col("m")) * weight).alias("base"))
    ranks = ranks.join(size, "group").select(*keys, "value", (F.col("upto") - (c - 1) / 2 - absent(F.col("upto") + F.col("after"))).alias("gain"))
    points = rows.join(ranks, [*keys, "value"]).groupBy("group", "item").agg(F.sum(F.col("gain") * weight).alias("gain"))
    total = items.join(points, ["group", "item"], "left").join(if_small(cut(base, "borda-base"), 64), "group", "left")
    penalty = F.round(F.coalesce("base", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), 6)
    total = total.select("group", "item", penalty.alias("penalty"))
    return row_numbers(total, ["group"], [F.col("penalty").asc(), F.col("item").asc()], "place", "borda-places")


def hit_scores(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search hits as (scores, items): the raw score (larger is better) and the place in each channel (smaller is better)."""
    items = hits.select(F.col("query_id").alias("group"), F.col("hit_id").alias("item"))
    keys = [F.col("query_id").alias("group"), F.col("hit_id").alias("item")]
    score = hits.select(*keys, F.lit("score").alias("metric"), (-F.col("score")).alias("value"))
    places = hits.select(*keys, F.explode("channels").alias("metric", "value"))
    places = places.select("group", "item", F.concat(F.lit("channel "), "metric").alias("metric"), F.col("value").cast("double"))
    return score.unionByName(places), items
