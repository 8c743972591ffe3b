"""Items into containers of fixed capacity: shortest pack first over the histogram of lengths."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.ranking import row_numbers


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns (copies, ((length, count), ...)) that place every item of a histogram of lengths 1..capacity.

    Lengths go longest first; each item goes into the pack with the most space left if it fits there, else into a new one.
    Packs of one pattern are handled together, so the work depends on the number of lengths, not on the number of items.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # space left -> [copies, pattern]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            space = max((s for s in groups if groups[s]), default=-1)
            if space >= length:
                copies, pattern = groups[space].pop()
                # items spread one by one over the emptiest packs: a pack takes another only when all have had one
                used = min(copies, left)
                if used < copies:
                    groups[space].append([copies - used, pattern])
                groups[space - length].append([used, _with(pattern, length)])
                left -= used
            else:
                # a new pack is then the emptiest, so it takes items of this length until it is full
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    groups[capacity - each * length].append([full, ((length, each),)])
                if rest:
                    groups[capacity - rest * length].append([1, ((length, rest),)])
                left = 0
        for space, packs in groups.items():  # equal patterns are one group again
            same: dict[tuple, int] = defaultdict(int)
            for copies, pattern in packs:
                same[pattern] += copies
            groups[space] = [[c, p] for p, c in same.items()]
    return [(c, p) for space in sorted(groups) for c, p in groups[space]]


def _with(pattern: tuple, length: int) -> tuple:
    if pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + 1))
    return (*pattern, (length, 1))


def places(patterns: list[tuple[int, tuple]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, items per container, first container, unused) of each length in each pattern."""
    rows, seen, base = [], defaultdict(int), 0
    for copies, pattern in patterns:
        unused = capacity - sum(n * c for n, c in pattern)
        for length, per in pattern:
            first = seen[length]
            seen[length] += per * copies
            rows.append((length, first, seen[length], per, base, unused))
        base += copies
    return rows


def pack(spark: SparkSession, items: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """(pack_name, container, key, piece, tokens, unused): the container of every item, or of every piece of a large item.

    Only items larger than a container are split, into full pieces and a rest. The histogram of piece lengths, bounded by
    the capacity, is packed on the driver; its patterns are joined back to the pieces by their rank within their length.
    Items of size 0 or null take no container and give no row. Rows that repeat a key are items of their own; ``key`` must
    not be null. Ranks are running sums over ranges, so a length that a third of all items have is spread over many tasks.
    """
    spec = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).cast("long").alias("cap")) for n, c in sorted(capacities.items())])
    rows = items.where(F.col(size) > 0).select(F.col(key).alias("k"), F.col(size).cast("long").alias("n"))
    rows = rows.select("k", "n", F.inline(spec))
    last = F.ceil(F.col("n") / F.col("cap")).cast("long") - 1
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("pack_name", "k", "piece", F.least("cap", F.col("n") - F.col("piece") * F.col("cap")).alias("tokens"))
    ranked = row_numbers(rows, ["pack_name", "tokens"], [F.col("k").asc(), F.col("piece").asc()], "rank", "packing")
    # at most one row per pack and length
    counted = ranked.groupBy("pack_name", "tokens").agg(F.max("rank").alias("c")).collect()
    table = []
    for name, capacity in sorted(capacities.items()):
        histogram = {r.tokens: r.c for r in counted if r.pack_name == name}
        table += [(name, *r) for r in places(pack_lengths(histogram, capacity), capacity)]
    schema = "pack_name string, tokens long, lo long, hi long, per long, base long, unused long"
    where = spark.createDataFrame(table, schema)
    # the table of places is bounded by the capacities, whatever the number of items
    r0 = F.col("rank") - 1
    placed = ranked.join(F.broadcast(where), ["pack_name", "tokens"]).where((r0 >= F.col("lo")) & (r0 < F.col("hi")))
    container = F.col("base") + F.floor((r0 - F.col("lo")) / F.col("per")).cast("long")
    return placed.select("pack_name", container.alias("container"), F.col("k").alias(key), "piece", "tokens", "unused")
