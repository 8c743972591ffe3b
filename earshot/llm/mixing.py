"""Mixing sources to target weights by min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators.ranking import running_total
from earshot.session import cut


class Flow:
    """Min-cost flow on a small graph, by cheapest augmenting paths with whole-number capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        sent = 0
        while True:
            far, by = [None] * len(self.out), [-1] * len(self.out)
            far[s] = 0
            queue, waiting = deque([s]), {s}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for e in self.out[u]:
                    v, d = self.to[e], far[u] + self.cost[e]
                    if self.cap[e] > 0 and (far[v] is None or d < far[v]):
                        far[v], by[v] = d, e
                        if v not in waiting:
                            queue.append(v)
                            waiting.add(v)
            if far[t] is None:
                return sent
            path, v = [], t
            while v != s:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            sent += push


def route(supply: Mapping[frozenset, int], shares: Mapping[str, float], repeats: Mapping[str, int], total: int) -> dict:
    """{(pattern, source): tokens}: token capacity of each membership pattern routed to the quotas of its sources.

    The n-th use of a pattern's tokens costs n (so the marginal cost rises and fresh text is used before any is repeated);
    a text that belongs to several sources is used at most as often as the strictest of them allows.
    """
    patterns, sources = sorted(supply, key=sorted), sorted(shares)
    node = {x: i for i, x in enumerate(["s", "t", *patterns, *sources])}
    g, arcs = Flow(len(node)), {}
    for p in patterns:
        for use in range(1, min(repeats[x] for x in p) + 1):
            g.arc(node["s"], node[p], supply[p], use)
        for x in p:
            arcs[p, x] = g.arc(node[p], node[x], supply[p] * repeats[x])
    for x in sources:
        g.arc(node[x], node["t"], int(shares[x] * total))
    g.run(node["s"], node["t"])
    return {k: g.cap[e ^ 1] for k, e in arcs.items() if g.cap[e ^ 1]}


def largest_total(supply: Mapping[frozenset, int], shares: Mapping[str, float], repeats: Mapping[str, int]) -> int:
    """The largest total size at which every source that has texts can still reach its share."""
    found = {x for p, n in supply.items() if n for x in p if repeats[x]}
    asked = sum(shares.values())
    shares = {x: s if x in found else 0.0 for x, s in shares.items()}
    lo, hi = 0, sum(n * max(repeats[x] for x in p) for p, n in supply.items())
    if 0 < sum(shares.values()) < asked:
        hi = int(hi * asked / sum(shares.values()))  # the share of those without texts stays unused
    while lo < hi:
        mid = (lo + hi + 1) // 2
        want = sum(int(s * mid) for s in shares.values())
        lo, hi = (mid, hi) if sum(route(supply, shares, repeats, mid).values()) >= want else (lo, mid - 1)
    return lo


def mix(
    spark: SparkSession,
    docs: DataFrame,
    targets: Mapping[str, tuple[float, int]],
    *,
    total: int | None = None,
    seed: int = 1,
) -> DataFrame:
    """(doc_id, source, n_tokens, times, target_share, share) for every row of ``docs`` (doc_id, source, text, n_tokens).

    ``targets`` gives each source's share of all tokens and how often its texts may be used. Without ``total`` the mix is
    the largest one in which every source that has texts reaches its share; with it, sources that run short give what they have.

    Equal texts are one text, whatever ids they have; the sources it is found in are its membership pattern. Token sums
    per pattern (at most 2 to the number of sources, in practice few) go to the driver, where a min-cost flow routes them
    to the sources. Within a pattern, texts lie on a line in an order drawn from ``seed``; each use is one pass along the
    line, and the flow cuts the passes into stretches for the sources. A text is used once for every pass in which its
    middle lies in a stretch. So shares are met to within one text per stretch, and the line is a running sum over ranges:
    a source with a third of all rows is spread over many tasks.

    ``times`` is counted at the first doc_id (per source) of equal texts and 0 at the others. Rows of null or unlisted
    source, null or empty text, or no tokens have times 0. Null doc_ids are left out. Shares are of the tokens used.
    """
    names = sorted(targets)
    if len(names) > 60:
        raise ValueError("more than 60 sources do not fit a membership pattern")
    bit = F.lit(0).cast("long")
    for i, name in enumerate(names):
        bit = F.when(F.col("source") == name, F.lit(1 << i).cast("long")).otherwise(bit)
    rows = docs.where("doc_id is not null").select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.sha2("text", 256).alias("print"))
    rows = cut(rows.withColumn("bit", F.when(F.col("n_tokens") > 0, bit).otherwise(F.lit(0).cast("long"))), "mix-rows")
    texts = rows.where("bit > 0").groupBy("print").agg(F.bit_or("bit").alias("pattern"), F.max("n_tokens").alias("n"))
    texts = texts.withColumn("draw", F.xxhash64(F.lit(seed), "print"))
    line = cut(running_total(texts, ["pattern"], [F.col("draw").asc(), F.col("print").asc()], F.col("n"), "upto", "mix-line"), "mix-line")

    of = lambda mask: frozenset(n for i, n in enumerate(names) if mask >> i & 1)
    supply = {of(r.pattern): r.n for r in line.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    shares, repeats = {n: targets[n][0] for n in names}, {n: targets[n][1] for n in names}
    reach = total if total is not None else largest_total(supply, shares, repeats)
    flow = route(supply, shares, repeats, reach) if supply else {}
    stretches, at = [], dict.fromkeys(supply, 0)
    for (p, x), n in sorted(flow.items(), key=lambda kv: (sorted(kv[0][0]), kv[0][1])):
        mask = sum(1 << names.index(s) for s in p)
        for use in range(at[p] // supply[p], (at[p] + n - 1) // supply[p] + 1):  # the passes that the stretch lies in
            lo, hi = max(at[p], use * supply[p]), min(at[p] + n, (use + 1) * supply[p])
            stretches.append((mask, x, lo - use * supply[p], hi - use * supply[p]))
        at[p] += n
    # a few rows per pattern and source: bounded by the targets, not by the data
    cuts = F.broadcast(spark.createDataFrame(stretches, "pattern long, source string, lo long, hi long"))
    middle = F.col("upto") - F.col("n") / 2
    used = line.join(cuts, "pattern").where((middle >= F.col("lo")) & (middle < F.col("hi")))
    used = used.groupBy("print", "source").agg(F.count(F.lit(1)).alias("times"))
    # a text copied a million times is one row per task before it travels
    first = rows.where("bit > 0").groupBy("print", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    # both grow with the texts, which the planner can't see from the size of their files
    chosen = cut(first.join(used.hint("merge"), ["print", "source"]).select("doc_id", "source", "n_tokens", "times"), "mix-chosen")
    sums = chosen.groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("n")).collect()  # one row per source
    every = sum(r.n for r in sums)
    reached = {r.source: r.n / every for r in sums}
    report = spark.createDataFrame([(n, shares[n], reached.get(n, 0.0)) for n in names], "source string, target_share double, share double")
    out = rows.select("doc_id", "source", "n_tokens").join(chosen.select("doc_id", "source", "times").hint("merge"), ["doc_id", "source"], "left")
    out = out.join(F.broadcast(report), "source", "left")
    return out.select("doc_id", "source", "n_tokens", F.coalesce("times", F.lit(0)).alias("times"), "target_share", "share")
