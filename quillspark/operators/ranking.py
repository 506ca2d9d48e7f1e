"""Ranking by sparse terms or dense vectors, reranking, per-group nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot
from .blocks import across, codes, matrix


def term_cosine(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """Every row of docs with `score`, the cosine of its terms with the query's; 0 if none is shared.

    All within the row: the terms' hashes are sorted once, equal neighbours give the norm, and the query's few
    terms are literals. No shuffle, no join. key names the row and is left as it is.
    """
    asked: dict[str, int] = {}
    for t in tx.terms_of(query):
        asked[t] = asked.get(t, 0) + 1
    length = sum(n * n for n in asked.values()) ** 0.5
    shared = F.lit(0.0)
    if asked:
        weight = F.create_map(*[F.lit(x) for t, n in asked.items() for x in (t, float(n))])
        shared = F.aggregate(F.filter(F.col("_terms"), lambda t: t.isin(*asked)), F.lit(0.0), lambda s, t: s + F.element_at(weight, t))
    ordered = F.array_sort(F.transform("_terms", lambda t: F.xxhash64(t)))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, h: Column) -> Column:
        run = F.when(a["last"] == h, a["run"] + 1).otherwise(1.0)
        return F.struct(h.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))  # squares are sums of odd numbers

    square = F.aggregate(ordered, zero, step, lambda a: a["sum"])
    score = F.when(F.size("_terms") > 0, shared / (F.sqrt(square) * length)) if asked else F.lit(0.0)
    return docs.withColumn("_terms", tx.terms(text)).withColumn("score", F.coalesce(score, F.lit(0.0))).drop("_terms")


def jaccard_words(a: Column, b: Column) -> Column:
    """Shared share of the lower-cased white-space token sets."""
    x, y = F.array_distinct(tx.words(F.lower(a))), F.array_distinct(tx.words(F.lower(b)))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def offline_rerank(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """Term cosine plus token Jaccard as `rerank_score`, of a short list."""
    return term_cosine(docs, key, text, query).withColumn("rerank_score", F.col("score") + jaccard_words(text, F.lit(query)))


def cosine_rank(docs: DataFrame, vector: Column, query: Column) -> DataFrame:
    """E5: inner product of unit vectors as `score`."""
    return docs.withColumn("score", dot(vector, query))


def top_k(docs: DataFrame, k: int, score: str, ordinal: str) -> DataFrame:
    """The k best, ties in input order; a partial top-k per task, then one merge."""
    return docs.orderBy(F.desc(score), F.asc(ordinal)).limit(k)


#: Queries and items of a block, on average.
ASKED, ITEMS = 512, 8192


def group_top_k(items: DataFrame, queries: DataFrame, group: str, ordinal: str, k: int) -> DataFrame:
    """For each query and group, the k items of largest inner product (to nine digits), ties to the smaller ordinal.

    items: group, ordinal, vec; queries: query_id, qvec; rows that lack one take no part. Blocks of queries against blocks of items: a matrix product
    a task, which keeps each query's and group's own k best; those merge.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ("query_id", group, ordinal, "similarity")
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": asked.column("query_id").slice(0, 0), group: held.column(group).slice(0, 0), ordinal: held.column(ordinal).slice(0, 0), "similarity": pa.array([], pa.float64())})
        ids, own = held.column(ordinal).to_numpy(), codes(held.column(group))
        a, b = matrix(asked.column("qvec")), matrix(held.column("vec"))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        score = np.round(a @ b.T, 9)
        at_q, at_i = [], []
        for g in np.unique(own):
            part = np.flatnonzero(own == g)
            part = part[np.argsort(ids[part], kind="stable")]
            order = np.argsort(-score[:, part], axis=1, kind="stable")[:, :k]
            at_q.append(np.repeat(np.arange(len(a)), order.shape[1])), at_i.append(part[order].ravel())
        at_q, at_i = np.concatenate(at_q), np.concatenate(at_i)
        cols = (asked.column("query_id").take(pa.array(at_q)), held.column(group).take(pa.array(at_i)), held.column(ordinal).take(pa.array(at_i)), pa.array(score[at_q, at_i]))
        return pa.table(dict(zip(names, cols, strict=True)))

    schema = f"query_id {dict(queries.dtypes)['query_id']}, `{group}` {kinds[group]}, `{ordinal}` {kinds[ordinal]}, similarity double"
    found = across(queries.select("query_id", "qvec").dropna(), items.select(group, ordinal, "vec").dropna(), ASKED, ITEMS, "query_id", ordinal, compare, schema)
    order = Window.partitionBy("query_id", group).orderBy(F.desc("similarity"), ordinal)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_context(found: DataFrame, group: str, ordinal: str, cap: int | None) -> DataFrame:
    """queries' hits as one list per group: best score per item, the cap best, in document order."""
    best = found.groupBy(group, ordinal).agg(F.max("similarity").alias("similarity"))
    if cap:
        order = Window.partitionBy(group).orderBy(F.desc("similarity"), ordinal)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")
    return best.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(ordinal)))


def index_label(chunks: DataFrame, key: str, source: str = "Full PDF") -> DataFrame:
    """What an index says of itself."""
    n = F.count(F.lit(1))
    return chunks.groupBy(key).agg(F.concat(F.lit("RAG ("), n.cast("string"), F.lit(" chunk"), F.when(n != 1, "s").otherwise(""), F.lit(f" from {source})")).alias("label"))


def transparency(found: DataFrame, text: Column) -> DataFrame:
    """Similarity rounded to 3 and a preview of 200 characters."""
    return found.withColumn("similarity", tx.rounded(F.col("similarity"), 3)).withColumn("preview", tx.truncate(text, 200))


def pca(rows: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Projection on the first k principal components; signs are free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(held).transform(held).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")
