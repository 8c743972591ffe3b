"""Neural models behind protocols: built on the executors, once per task, and fed in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.operators.late import half


class TextEncoder(Protocol):
    """Texts to vectors."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class TokenEncoder(Protocol):
    """Texts to one matrix each, a row per token."""

    def encode(self, texts: Sequence[str]) -> Sequence[np.ndarray]: ...


class PairJudge(Protocol):
    """How well a passage answers a query, from 0 to 1."""

    def predict(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class VoiceEncoder(Protocol):
    """Equally long stretches of mono samples to vectors of the voice."""

    def encode(self, waves: np.ndarray) -> np.ndarray: ...


def _in_batches(items: list, size: int, work: Callable[[list], Sequence]) -> list:
    out: list = []
    for a in range(0, len(items), size):
        out.extend(work(items[a : a + size]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def text_vectors(make: Callable[[], TextEncoder], *, batch: int = 32) -> Callable[[Column, int], Column]:
    """A column function (text, dim) -> unit vector of the encoder that ``make`` builds; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            known = s.dropna()
            found = _in_batches(known.tolist(), batch, lambda t: list(_unit(np.asarray(model.encode(t), np.float32))))
            yield pd.Series(found, index=known.index, dtype=object).reindex(s.index).where(s.notna(), None)

    return lambda text, dim: run(text)


def token_matrices(make: Callable[[], TokenEncoder], *, batch: int = 32) -> Callable[[Column, int], Column]:
    """A column function (text, dim) -> matrix of the encoder that ``make`` builds, as half-precision bytes."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            known = s.dropna()
            found = _in_batches(known.tolist(), batch, lambda t: [half(m) for m in model.encode(t)])
            yield pd.Series(found, index=known.index, dtype=object).reindex(s.index).where(s.notna(), None)

    return lambda text, dim: run(text)


def judged(make: Callable[[], PairJudge], *, batch: int = 32) -> Callable[[Column, Column], Column]:
    """A column function (query, passage) -> judgement of the model that ``make`` builds."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, p in parts:
            pairs = list(zip(q.fillna(""), p.fillna("")))
            yield pd.Series(_in_batches(pairs, batch, lambda x: list(map(float, model.predict(x)))), dtype="float64")

    return lambda query, passage: run(query, passage)
