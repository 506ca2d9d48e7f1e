"""A kept index of papers' chunks (E1, E2, E4, E9-E11): sparse vectors in a table bucketed by paper.

A chunk's vector is what it holds, places and counts of its hashed terms, not the 4,096 numbers it stands for. All of a paper's
chunks lie in one bucket, so scores, each paper's best chunks and their merging need no shuffle, and adding papers
touches no other ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 4096
_VECTOR = "struct<at:array<int>,n:array<int>,norm:double>"


def hashed(text: str | None, width: int = WIDTH) -> dict[int, int]:
    """How often each place is hit by a text's words and word pairs, places ascending: what hashing_embedder counts, without its zeros."""
    words = re.findall(r"\w\w+", (text or "").lower())
    counts = Counter(zlib.crc32(t.encode()) % width for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])
    return dict(sorted(counts.items()))


def _norm(counts: dict[int, int]) -> float:
    return sum(n * n for n in counts.values()) ** 0.5


def _vectors(texts: pd.Series, width: int) -> pd.DataFrame:
    """at, n and norm of each text. A text's counts become two short arrays before the next is read: a batch of dicts and lists of numbers is some twenty times as large."""
    at, n, norm = [], [], []
    for t in texts:
        found = hashed(t, width)
        at.append(np.fromiter(found, np.int32, len(found)))
        n.append(np.fromiter(found.values(), np.int32, len(found)))
        norm.append(_norm(found))
    return pd.DataFrame({"at": at, "n": n, "norm": norm})


def sparse(text: Column, width: int = WIDTH) -> Column:
    """A text's places, counts and norm; small numbers, which a column stores in a few bits each. Null texts are empty."""

    @F.pandas_udf(_VECTOR)
    def run(texts: pd.Series) -> pd.DataFrame:
        return _vectors(texts, width)

    return run(text)


def sparse_cosine(vector: str, query: dict[int, int]) -> Column:
    """Cosine of a sparse column with a query's few places; 0 where either is empty."""
    if not query:
        return F.lit(0.0)
    weight = F.create_map(*[F.lit(x) for at, n in query.items() for x in (at, n)])
    held = F.filter(F.arrays_zip(F.col(f"{vector}.at").alias("at"), F.col(f"{vector}.n").alias("n")), lambda x: x["at"].isin(*query))
    shared = F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.element_at(weight, x["at"]))
    return F.coalesce(F.try_divide(shared.cast("double"), F.col(f"{vector}.norm") * _norm(query)), F.lit(0.0))


class PaperIndex:
    """Chunks under a table name, by column `key`. add() as often as papers come; drop() when done."""

    def __init__(self, spark: SparkSession, name: str, key: str = "paper_id", buckets: int = 64, width: int = WIDTH):
        self.spark, self.name, self.key, self.buckets, self.width = spark, name, key, buckets, width

    def add(self, chunks: DataFrame, prefix: str = "") -> None:
        """chunks: key, chunk_ord, chunk_text and others, which are kept. A paper is added whole, once."""
        rows = chunks.withColumn("vec", sparse(F.concat(F.lit(prefix), F.coalesce("chunk_text", F.lit(""))), self.width))
        rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key, "chunk_ord").mode("append").format("parquet").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def search(self, queries: list[tuple[str, int]], cap: int | None = None, prefix: str = "") -> DataFrame:
        """As retrieve(): per paper its best chunks for (query, k) pairs, a chunk once at its best similarity (to nine
        digits), the `cap` best, in document order as `position`. No shuffle."""
        scores = F.array(*[F.round(sparse_cosine("vec", hashed(prefix + q, self.width)), 9) for q, _ in queries])
        most = F.array(*[F.lit(k) for _, k in queries])
        each = self.rows().select(self.key, "chunk_ord", F.posexplode(scores).alias("query_id", "similarity"))
        by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("similarity"), "chunk_ord")
        best = each.withColumn("_at", F.row_number().over(by(self.key, "query_id"))).where(F.col("_at") <= F.element_at(most, F.col("query_id") + 1))
        merged = best.groupBy(self.key, "chunk_ord").agg(F.max("similarity").alias("similarity"))
        if cap:
            merged = merged.withColumn("_at", F.row_number().over(by(self.key))).where(F.col("_at") <= cap).drop("_at")
        return merged.withColumn("position", F.row_number().over(Window.partitionBy(self.key).orderBy("chunk_ord")))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
