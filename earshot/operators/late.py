"""Late interaction: texts as one vector per token, compared token by token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.queries import QUERY_PREFIX
from earshot.functions.text import tokens


def maxsim(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l, r, score): of each pair (l, r), the sum over the tokens of ``left`` (id, vectors) of their best match in ``right``.

    The dot products stay in the JVM; only stated pairs are compared.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    top = lambda q: F.array_max(F.transform("rv", lambda d: dot(q, d)))
    rows = pairs.join(left.select(F.col("id").alias("l"), F.col("vectors").alias("lv")), "l")
    rows = rows.join(right.select(F.col("id").alias("r"), F.col("vectors").alias("rv")), "r")
    total = F.aggregate(F.transform("lv", top), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return rows.select("l", "r", F.round(total, 6).alias("score"))


def packed_maxsim(left: Column, right: Column, width: int) -> Column:
    """The same score of two texts kept by ``pack_half``: one matrix product per pair, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            q, d = (np.frombuffer(v, np.float16).astype(np.float32).reshape(-1, width) for v in (x, y))
            return float((d @ q.T).max(0).sum()) if len(q) and len(d) else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(left, right)


def packed_scores(asked: pa.Table, width: int):
    """For ``mapInArrow``: the score of ``packed_maxsim`` of pairs (query_id, id, colbert), with what a query asks in ``asked`` (query_id, asks).

    Pairs of other queries, and passages without vectors, have no score.
    """
    unpacked = lambda v: np.frombuffer(v, np.float16).astype(np.float32).reshape(-1, width)
    asks = dict(zip(asked["query_id"].to_pylist(), asked["asks"].to_pylist()))

    def run(batches):
        for x in batches:
            scores = []
            for k, v in zip(x.column("query_id").to_pylist(), x.column("colbert")):
                a, v = asks.get(k), v.as_buffer()
                if a is None or v is None:
                    scores.append(None)
                    continue
                q, d = unpacked(a), unpacked(v)
                scores.append(float((d @ q.T).max(0).sum()) if len(q) and len(d) else 0.0)
            yield pa.RecordBatch.from_arrays([x.column("query_id"), x.column("id"), pa.array(scores, pa.float64())], ["query_id", "id", "late"])

    return run


def half(vectors) -> bytes:
    return np.asarray(vectors, np.float16).tobytes()


def pack_half(vectors: Column) -> Column:
    """An array of vectors as bytes of half-precision numbers."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else half([np.asarray(v) for v in m]))

    return run(vectors)


def unpack_half(data: Column, width: int) -> Column:
    """The vectors of ``pack_half``, each of ``width`` numbers."""

    @F.pandas_udf("array<array<float>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else [list(map(float, v)) for v in np.frombuffer(b, np.float16).reshape(-1, width)])

    return run(data)


def signed_features(features: list[str], dim: int, seed: int = 17) -> np.ndarray:
    """A unit vector of hashed features: each adds to two places, with signs drawn from its hash. All zero without features."""
    drawn = np.array([xxhash.xxh3_64_intdigest(f, seed) for f in features], np.uint64)
    out = np.zeros(dim)
    for shift in (np.uint64(0), np.uint64(32)):
        part = drawn >> shift
        np.add.at(out, (part & np.uint64(0x7FFFFFFF)) % np.uint64(dim), np.where(part >> np.uint64(31) & np.uint64(1), 1.0, -1.0))
    size = np.linalg.norm(out)
    return (out / size if size else out).astype(np.float32)


def _plain(text: Column) -> Column:
    """The tokens of a text without the instruction that queries carry."""
    return tokens(F.replace(text, F.lit(QUERY_PREFIX), F.lit("")))


def word_vectors(text: Column, dim: int = 768) -> Column:
    """A stand-in for a sentence encoder: the words of a text as hashed features."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else signed_features(list(t), dim))

    return run(_plain(text))


def token_vectors(text: Column, dim: int = 256, at_a_time: int = 500) -> Column:
    """A stand-in for a token encoder: each word by its beginnings and endings, as half-precision bytes."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, np.ndarray] = {}  # words return; the table starts anew when it is full
        def one(w):
            if w not in known:
                if len(known) > 50_000:
                    known.clear()
                n = range(1, min(len(w), 6) + 1)
                known[w] = signed_features([f"^{w[:i]}" for i in n] + [f"{w[-i:]}$" for i in n], dim)
            return known[w]

        for s in parts:
            for a in range(0, len(s), at_a_time):  # vectors of few texts leave at a time
                yield s.iloc[a : a + at_a_time].map(lambda t: None if t is None else half([one(w) for w in t]))

    return run(_plain(text))


def shared_words(query: Column, passage: Column) -> Column:
    """A stand-in for a reranker: the share of the query's tokens found in the passage's."""
    asked, said = tokens(query), tokens(passage)
    found = F.size(F.array_intersect(asked, said)).cast("double")
    return F.when(F.size(asked) > 0, found / F.size(F.array_distinct(asked))).otherwise(0.0)


