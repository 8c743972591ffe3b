"""The most similar vectors of every vector: a forest of sorted hash strings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.search import if_small
from earshot.session import cut, discard

#: A sketch has this many coordinates of four bits.
SKETCH = 64
STEP = 0.5
ROWS = 2048
SKETCHED = [f"s{i}" for i in range(SKETCH // 16)]


def _planes(dim: int, trees: int, symbols: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Random directions of the hash strings, a random rotation for the sketch, and the bits of one symbol."""
    width = 1 << max(1, min(6, int(math.log2(dim))))
    rng = np.random.default_rng(seed)
    strings = rng.standard_normal((dim, trees * symbols * width)).astype(np.float32)
    turn = np.linalg.qr(rng.standard_normal((max(dim, SKETCH), max(dim, SKETCH))))[0][:dim, :SKETCH]
    # coordinates of a unit vector then have a spread of about 1
    return strings, (turn * math.sqrt(max(dim, SKETCH))).astype(np.float32), int(math.log2(width)) + 1


def _packed(x: np.ndarray) -> np.ndarray:
    """Coordinates as four-bit steps, sixteen to a number."""
    q = (np.clip(np.round(x / STEP), -8, 7).astype(np.int8) + 8).astype(np.uint8)
    return (q[:, ::2] << 4 | q[:, 1::2]).view(np.int64)


def _unpacked(parts: list[np.ndarray]) -> np.ndarray:
    """Unit-like vectors from sketches: their dot products are cosines but for rounding."""
    b = np.ascontiguousarray(np.stack(parts, 1)).view(np.uint8)
    q = np.empty((len(b), SKETCH), np.float32)
    q[:, ::2], q[:, 1::2] = b >> 4, b & 15
    return (q - 8) * np.float32(STEP / math.sqrt(SKETCH))


def _hasher(dim: int, trees: int, symbols: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, sketch, bits = _planes(dim, trees, symbols, seed)
        width = 1 << (bits - 1)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, vectors = batch.column(0), batch.column(1)
                right = pa.compute.equal(pa.compute.list_value_length(vectors), dim)
                right = pa.compute.and_(pa.compute.fill_null(right, False), ids.is_valid())
                ids, vectors = ids.filter(right), vectors.filter(right)
                x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
                norm = np.sqrt((x * x).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                ids, x = ids.filter(pa.array(good)), (x[good] / norm[good, None]).astype(np.float32)
                if not len(x):
                    continue
                exact = np.round(x.astype(np.float64) * (1 << 20)).astype(np.int32)  # copies stay copies at any length
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in exact), np.int64).reshape(-1, 2)
                y = (x @ strings).reshape(len(x), trees, symbols, width)
                best = np.abs(y).argmax(3)
                sign = np.take_along_axis(y, best[..., None], 3)[..., 0] > 0
                symbol = (best * 2 + sign).astype(np.int64)
                code = np.zeros((len(x), trees), np.int64)
                for s in range(symbols):
                    code = (code << bits) | symbol[:, :, s]
                rough = _packed(x @ sketch)
                columns = [ids.cast(pa.string()), *[pa.array(c) for c in (*prints.T, *rough.T)]]
                columns += [pa.array(code[:, t]) for t in range(trees)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel())))
                names = ["id", "p0", "p1", *SKETCHED, *[f"h{t}" for t in range(trees)], "v"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: Steps of a descent: the longest prefixes shared by 2, 4, ... rows of a tree, six bits each in one number.
STEPS = 10
LEVEL_BITS = 6
#: Rows of a stretch of the sorted arrays that one task compares at once, and of the stretch before it that it sees too.
STRETCH, CONTEXT, TILE = 8192, 1024, 128


def _shared(a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The number of leading bits that two strings of ``length`` bits have in common."""
    x = (a ^ b).astype(np.uint64)
    size = np.zeros(len(x), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(step)
        size[big] += step
        x = np.where(big, x >> np.uint64(step), x)
    return length - size - (x > 0)


def descents(tree: np.ndarray, code: np.ndarray, length: int) -> np.ndarray:
    """For every row of a sorted array: the longest prefixes it shares with 1, 3, 7, ... 2 ** STEPS - 1 others.

    Rows that share a prefix stand together, so a prefix shared by n rows is that of the ends of some n neighbours.
    """
    n, out = len(code), np.zeros((len(code), STEPS), np.int64)
    for j in range(STEPS):
        span = 2 << j
        if span > n:
            break
        run = np.where(tree[: n - span + 1] == tree[span - 1 :], _shared(code[: n - span + 1], code[span - 1 :], length), 0)
        # the best of the runs that hold a row: a sliding maximum over `span` runs, by doubling
        best, width = np.concatenate([np.zeros(span - 1, np.int64), run, np.zeros(span - 1, np.int64)]), 1
        while width < span:
            best = np.maximum(best[: len(best) - width], best[width:])
            width *= 2
        out[:, j] = best[:n]
    return out


def _descender(length: int):
    """Rows (tree, code, p0) of a sorted partition with their place ``n`` in it and their packed descents."""
    reach = 1 << STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, done = None, 0, 0  # rows in hand, how many rows went before them, how many of those in hand were given out

        def give(cols, upto):
            deep = descents(cols[0], cols[1], length)[done:upto]
            packed = (deep << (LEVEL_BITS * np.arange(STEPS))).sum(1)
            place = np.arange(at + done, at + upto, dtype=np.int64)
            names = ["p0", "tree", "n", "steps"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (cols[2][done:upto], cols[0][done:upto], place, packed)], names)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            size = len(held[0])
            if size < 16 * reach:
                continue
            yield give(held, size - reach)
            drop = size - 2 * reach  # what stays: the rows not given out and as many before them
            held, at, done = [c[drop:] for c in held], at + drop, reach
        if held is not None and len(held[0]) > done:
            yield give(held, len(held[0]))

    return run


def ascent(steps: np.ndarray, trees: int, candidates: int) -> np.ndarray:
    """How far each vector has to rise, in all its trees at once, to meet ``candidates`` rows: the length of prefix it stops at.

    ``steps``: packed descents, one column per tree. All trees stand at the same length of prefix; it is shortened bit by
    bit until the rows below the vector's nodes are enough. A node counts as the power of two that it reaches.
    """
    top = 1 << LEVEL_BITS
    met = np.zeros((len(steps), top), np.int64)
    row = np.repeat(np.arange(len(steps)), trees)
    for j in range(STEPS):
        level = (steps >> (LEVEL_BITS * j)) & (top - 1)
        gain = (2 << j) - (1 << j)
        met += gain * np.bincount(row * top + level.ravel(), minlength=met.size).reshape(met.shape)
    enough = met[:, ::-1].cumsum(1)[:, ::-1] >= candidates
    return np.where(enough.any(1), top - 1 - enough[:, ::-1].argmax(1), 0)


def _planter(trees: int, candidates: int):
    """Of every vector (p0, sketch, codes, its places and descents by tree) the rows of the forest, with where its ascent ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            by = {k: batch.column(k) for k in batch.schema.names}
            place, steps = (np.stack(by[c].flatten().to_numpy(zero_copy_only=False).reshape(n, trees), 0) for c in ("places", "steps"))
            level = ascent(steps, trees, candidates)
            again = lambda c: np.repeat(by[c].to_numpy(zero_copy_only=False), trees)
            code = np.stack([by[f"h{t}"].to_numpy(zero_copy_only=False) for t in range(trees)], 1)
            columns = [place.ravel(), np.tile(np.arange(trees, dtype=np.int32), n), code.ravel(), np.repeat(level.astype(np.int32), trees)]
            columns += [again(c) for c in ("p0", *SKETCHED)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pos", "tree", "code", "level", "p0", *SKETCHED])

    return run


def _best_of_each(a: np.ndarray, b: np.ndarray, sim: np.ndarray, keep: int) -> np.ndarray:
    """Which pairs are among the ``keep`` best of one of their ends."""
    chosen = np.zeros(len(a), bool)
    for end in (a, b):
        order = np.lexsort((-sim, end))
        first = np.searchsorted(end[order], end[order])
        chosen[order[np.arange(len(a)) - first < keep]] = True
    return chosen


def near_pairs(tree, code, level, rough, own: int, length: int, least: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (a, b) of a stretch, a before b and b from ``own`` on, of rows that meet, with the cosine of their sketches.

    Two rows meet if they share the prefix at which the ascent of one of them ended, at most CONTEXT rows apart. Of those
    from ``least`` on, each row's ``keep`` best are given.
    """
    n = len(code)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if n else []
    for s, e in zip(starts, [*starts[1:], n]):
        rest, c = length - level[s:e].astype(np.int64), code[s:e]
        lo[s:e] = s + np.searchsorted(c, (c >> rest) << rest)
        hi[s:e] = s + np.searchsorted(c, ((c >> rest) + 1) << rest)
    out = []
    for b0 in range(own, n, TILE):
        b1, floor = min(n, b0 + TILE), max(0, b0 - CONTEXT)
        back = np.flatnonzero(hi[floor:b0] > b0)
        a0 = max(floor, min([b0, lo[b0:b1].min(), *(floor + back[:1])]))
        sim = rough[b0:b1] @ rough[a0:b1].T
        i, j = np.nonzero(sim >= least)
        a, b = a0 + j, b0 + i
        ok = (a < b) & ((lo[b] <= a) | (hi[a] > b))
        a, b, sim = a[ok], b[ok], sim[i[ok], j[ok]]
        if len(a) > keep:
            ok = _best_of_each(a, b, sim, keep)
            a, b, sim = a[ok], b[ok], sim[ok]
        out.append((a, b, sim))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def _walker(length: int, least: float, near: float, keep: int):
    """Stretches (block, pos, tree, code, level, p0, sketch), in order: the pairs of prints that meet, and whether they seem near."""

    def pairs(cols):
        block, pos, tree, code, level, prints = cols[:6]
        own = int(np.searchsorted(pos, block[0] * STRETCH))
        a, b, sim = near_pairs(tree, code, level, _unpacked(cols[6:]), own, length, least, keep)
        a, b = prints[a], prints[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sim >= near)], ["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            ends = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], False)) + 1
            for s, e in zip([0, *ends], ends):
                yield pairs([c[s:e] for c in held])
            if len(ends):
                held = [c[ends[-1] :] for c in held]
        if held is not None:
            yield pairs(held)

    return run


#: Vectors of a crowded region are compared in blocks of so many; leaders are sought among so many at once, up to so many in all.
BLOCK = 8192
SOUGHT = 2048
LEADERS = 8192


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _leaders(crowd: DataFrame, dim: int, near: float) -> np.ndarray:
    """At most LEADERS vectors of ``crowd``, such that (up to that number) every one has a cosine of ``near`` to one of them."""
    leaders = np.zeros((0, dim))
    while len(leaders) < LEADERS:
        found = leaders

        def far(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    if len(found):
                        batch = batch.filter(pa.array((_matrix(batch.column(0), dim) @ found.T).max(1) < near))
                    yield batch

        some = crowd.select("v").mapInArrow(far, "v array<float>").limit(SOUGHT).collect()
        if not some:
            break
        x = np.array([r.v for r in some], dtype=np.float64)
        sim, free, chosen = x @ x.T, np.ones(len(x), bool), []
        for i in range(len(x)):
            if free[i]:
                chosen.append(i)
                free &= sim[i] < near
        leaders = np.vstack([leaders, x[chosen[: LEADERS - len(leaders)]]])
    return leaders


def _crowded_pairs(vectors: DataFrame, crowded: DataFrame, dim: int, k: int, near: float) -> DataFrame:
    """(a, b): each vector of ``crowded`` (p0) with the most similar of all ``vectors`` (p0, v): ``k`` + 1 and those equal to the last.

    Only cosines from ``near`` on count. Every crowded vector belongs to the nearest of a few leaders. What is near to it
    can't be further from its leader than the leader's farthest member and the angle of ``near`` together, so comparing the
    members of a leader with all vectors within that angle misses none, however well the leaders lie.
    """
    crowd = cut(vectors.join(crowded.hint("merge"), "p0"), "forest-crowd")
    leaders = _leaders(crowd, dim, near)

    def near_leaders(wide: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    sim = _matrix(batch.column(1), dim) @ leaders.T
                    row, leader = (np.arange(len(sim)), sim.argmax(1)) if wide is None else np.nonzero(sim >= wide)
                    taken = [*batch.take(pa.array(row)).columns, pa.array(sim[row, leader])]
                    yield pa.RecordBatch.from_arrays([pa.array(leader.astype(np.int32)), *taken], ["leader", "p0", "v", "sim"])

        return run

    kinds = "leader int, p0 long, v array<float>, sim double"
    own = cut(crowd.select("p0", "v").mapInArrow(near_leaders(None), kinds), "forest-own")
    farthest = {r.leader: r.sim for r in own.groupBy("leader").agg(F.min("sim").alias("sim")).collect()}  # one row per leader
    angle = lambda c: math.acos(max(-1.0, min(1.0, c)))
    wide = np.array([math.cos(min(math.pi, angle(farthest.get(i, 1.0)) + angle(near))) - 1e-6 for i in range(len(leaders))])
    other = cut(vectors.select("p0", "v").mapInArrow(near_leaders(wide), kinds), "forest-around")
    blocks = lambda df, name: df.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = F.broadcast(cut(blocks(own, "m_of").join(blocks(other, "c_of"), "leader"), "forest-blocks"))  # at most LEADERS rows
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = own.join(sizes, "leader").select("leader", F.expr("pmod(p0, m_of)").alias("m"), every("c_of").alias("c"), "p0", "v")
    other = other.join(sizes, "leader").select("leader", every("m_of").alias("m"), F.expr("pmod(p0, c_of)").alias("c"), "p0", "v")

    def scan(left, right):
        a, b = left["p0"].to_numpy(), right["p0"].to_numpy()
        found = []
        if len(a) and len(b):
            x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (left, right))
            for at in range(0, len(a), 256):
                sim = x[at : at + 256] @ y.T
                sim[a[at : at + 256, None] == b[None, :]] = -2
                least = np.partition(sim, len(b) - k - 1, axis=1)[:, len(b) - k - 1] if len(b) > k + 1 else np.full(len(sim), -1.0)
                i, j = np.nonzero(sim >= np.maximum(least, near)[:, None] - 1e-12)
                found.append((a[at + i], b[j]))
        i, j = (np.concatenate(z) for z in zip(*found)) if found else (a[:0], a[:0])
        return pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    keys = ["leader", "m", "c"]
    return own.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(scan, "a long, b long")


def most_similar(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    *,
    dim: int,
    k: int = 3,
    min_cosine: float | None = None,
    trees: int = 12,
    symbols: int = 6,
    candidates: int = 512,
    near: float = 0.9,
    crowd: int = 8,
    seed: int = 7,
) -> DataFrame:
    """(id, other, cosine): for each id its ``k`` most similar other ids; only those from ``min_cosine`` on, if it is given.

    A hash-prefix forest. Every vector gets one long hash string per tree: symbols of random cross-polytopes (the axis
    nearest to the rotated vector, with its sign). Each tree is the sorted array of its strings.

    - Descent: in every tree each row finds the longest prefixes that it shares with 1, 3, 7, ... other rows.
    - Synchronous ascent: a vector stands at the same length of prefix in all its trees; the length is shortened bit by bit
      until its nodes hold ``candidates`` rows together. So the prefixes are long where vectors are many and short where they are few.
    - Rows below such a node are compared by sketches of four-bit coordinates. With ``min_cosine`` those that can't reach it
      (more than four standard deviations of slack) are dropped; without it the best 4 ``k`` of a row in each tree are kept.
      The exact cosine decides.
    - A vector that meets ``crowd`` others that seem nearer than ``near`` may have more of them than it met. It is compared
      exactly with everything in its region (``_crowded_pairs``), in time quadratic in the region.

    The sorted arrays are one line, cut into stretches of 8192 rows that see the last 1024 rows before them; so nothing
    depends on the number of partitions, and vectors crowded in one place spread over many tasks. A node never
    needs more rows than that: with as many the ascent would have ended twice over.

    Exact copies (also at another length) are one class in the forest; afterwards each copy is linked to the first
    ``k`` + 1 ids of its class and of the classes near it, so a group of copies gives links in proportion to its size.
    Equal cosines are ordered by id. Ids are compared and returned as strings; rows that repeat an id and vector count
    once. Null, empty, all-zero or non-finite vectors, those of another dimension, and null ids are left out. An empty
    table gives an empty result.
    """
    _, _, bits = _planes(dim, 1, 1, seed)
    length = bits * symbols
    if length >= 1 << LEVEL_BITS:
        raise ValueError(f"hash strings of {length} bits: at most {(1 << LEVEL_BITS) - 1}")
    hashed = ["h%d" % t for t in range(trees)]
    fields = ["id string", *[f"{c} long" for c in ("p0", "p1", *SKETCHED, *hashed)], "v array<float>"]
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    members = cut(source.mapInArrow(_hasher(dim, trees, symbols, seed), ", ".join(fields)), "forest-vectors")
    one = [F.first(c).alias(c) for c in (*SKETCHED, *hashed)]
    classes = cut(members.groupBy("p0").agg(*one), "forest-classes")

    rows = F.array(*[F.struct(F.lit(t).alias("tree"), F.col(h).alias("code")) for t, h in enumerate(hashed)])
    line = classes.select(F.inline(rows), "p0").repartitionByRange("tree", "code", "p0").sortWithinPartitions("tree", "code", "p0")
    line = line.mapInArrow(_descender(length), "p0 long, tree int, n long, steps long").withColumn("part", F.spark_partition_id())
    line = cut(line, "forest-line")
    # one row per partition of the line
    sizes = line.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    base = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = line.join(F.broadcast(sizes.select("part", base.alias("base"))), "part").select("p0", F.struct("tree", (F.col("base") + F.col("n")).alias("pos"), "steps").alias("r"))
    placed = placed.groupBy("p0").agg(F.array_sort(F.collect_list("r")).alias("r"))
    placed = placed.select("p0", F.transform("r", lambda r: r["pos"]).alias("places"), F.transform("r", lambda r: r["steps"]).alias("steps"))
    forest = placed.join(classes.hint("merge"), "p0")
    forest = forest.mapInArrow(_planter(trees, candidates), ", ".join(["pos long, tree int, code long, level int, p0 long", *[f"{c} long" for c in SKETCHED]]))
    block = F.floor(F.col("pos") / STRETCH)
    both = F.when(F.col("pos") % STRETCH >= STRETCH - CONTEXT, F.array(block, block + 1)).otherwise(F.array(block))
    forest = forest.select(F.explode(both).alias("block"), "pos", "tree", "code", "level", "p0", *SKETCHED)
    forest = forest.repartition("block").sortWithinPartitions("block", "pos")

    slack = 0.12 if dim <= SKETCH else 0.16
    near = near if min_cosine is None else max(near, min_cosine)
    least, keep = (-2.0, max(crowd, 4 * k)) if min_cosine is None else (min_cosine - slack, max(crowd, 4 * k))
    found = forest.mapInArrow(_walker(length, least, near - slack, keep), "a long, b long, near boolean")
    found = cut(found.groupBy("a", "b").agg(F.max("near").alias("near")), "forest-pairs")
    discard(line, classes)
    pairs = found.select("a", "b")

    met = found.where("near").select(F.explode(F.array("a", "b")).alias("p0")).groupBy("p0").count()
    crowded = cut(met.where(F.col("count") >= crowd).select("p0"), "forest-crowded")
    if not crowded.isEmpty():
        vectors = cut(members.groupBy("p0", "p1").agg(F.first("v").alias("v")).select("p0", "v"), "forest-vectors-once")
        if min_cosine is not None and min_cosine >= near:  # the exact way gives all of their links
            at = lambda c: crowded.select(F.col("p0").alias(c), F.lit(True).alias(f"{c}_in")).hint("merge")
            pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("a_in is null or b_in is null").select("a", "b")
        pairs = cut(pairs.unionByName(_crowded_pairs(vectors, crowded, dim, k, near)).distinct(), "forest-all-pairs")

    # only vectors of some pair are looked at again; two vectors of one first print would both be
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("p0")).distinct(), "forest-ends")
    near_ones = members.select("p0", "p1", "v").join(if_small(ends, 16), "p0").groupBy("p0", "p1").agg(F.first("v").alias("v"))
    near_ones = cut(near_ones.select(F.struct("p0", "p1").alias("c"), "p0", "v"), "forest-near")
    va = near_ones.select(F.col("p0").alias("a"), F.col("c").alias("ca"), F.col("v").alias("va")).hint("merge")
    vb = near_ones.select(F.col("p0").alias("b"), F.col("c").alias("cb"), F.col("v").alias("vb")).hint("merge")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    links = pairs.join(va, "a").join(vb, "b").select("ca", "cb", dot.alias("cosine"))
    links = cut(links if min_cosine is None else links.where(F.col("cosine") >= min_cosine), "forest-links")

    # copies of a class are linked to its first ids, and so are the classes near it
    ids = members.select("id", F.struct("p0", "p1").alias("c")).distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= k + 1)
    copied = first.where("r = 2").select("c", F.col("c").alias("d"), F.lit(1.0).alias("cosine"))
    turned = links.select(F.col("cb").alias("c"), F.col("ca").alias("d"), "cosine")
    lists = cut(links.select(F.col("ca").alias("c"), F.col("cb").alias("d"), "cosine").unionByName(turned).unionByName(copied), "forest-lists")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("cosine").desc(), F.col("other")))
    wanted = cut(lists.select("d").distinct(), "forest-wanted")
    other = cut(first.select(F.col("c").alias("d"), F.col("id").alias("other")).join(if_small(wanted, 32), "d"), "forest-others")
    lists = lists.join(other.hint("merge"), "d").withColumn("r", best("c")).where(F.col("r") <= k + 1)
    lists = cut(lists.select("c", "other", "cosine"), "forest-best")
    links = ids.join(if_small(lists, 96), "c").where("id <> other").withColumn("r", best("id")).where(F.col("r") <= k)
    return links.select("id", "other", "cosine")
