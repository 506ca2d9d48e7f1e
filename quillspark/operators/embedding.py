"""Pluggable embedding and pair scoring (E1-E3, E7), with term vectors as the fallback.

An embedder is a factory: called once per Python worker, it returns a function from a list of texts to a
list of vectors. The first factory of a chain that works is used (E3); none working leaves term cosine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[], Callable[[list[str]], list]]
_loaded: dict[bytes, object] = {}


def hashing_embedder(width: int = 4096) -> Embedder:
    """Word and word-pair counts dealt to `width` places by crc32: the embedder that needs no model."""

    def factory():
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width), np.float32)
            for i, t in enumerate(texts):
                words = re.findall(r"\w\w+", t.lower())
                for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                    out[i, zlib.crc32(term.encode()) % width] += 1
            return out

        return run

    return factory


def first_working(chain: list[Embedder]) -> Embedder | None:
    """Tried on the driver, once."""
    for factory in chain:
        try:
            factory()(["probe"])
            return factory
        except Exception:  # noqa: BLE001  a model may fail to load in any way
            continue
    return None


def _once(factory: Embedder):
    """The factory's model, made once per Python worker. Workers serve many queries, so factories are told apart by what they hold."""
    key = cloudpickle.dumps(factory)
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def embed(rows: DataFrame, text: str, factory: Embedder, prefix: str = "", out: str = "vec") -> DataFrame:
    """Unit vectors (float) of prefix + text, in Arrow batches; null text embeds as empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _once(factory)
        for batch in batches:
            v = np.asarray(model([prefix + (t or "") for t in batch]), dtype=np.float64).reshape(len(batch), -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(n > 0, n, 1)).astype(np.float32)))

    return rows.withColumn(out, run(F.col(text)))


def cross_score(rows: DataFrame, query: str, text: str, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], out: str = "rerank_score") -> DataFrame:
    """A joint score of (query, text) pairs, of a short list."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _once(factory)
        for batch in batches:
            yield pd.Series([float(x) for x in model([(query, t or "") for t in batch])], dtype="float64")

    return rows.withColumn(out, run(F.col(text)))
