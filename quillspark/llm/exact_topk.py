"""Exact top-k by inner product: a forest of M-trees, searched best-first.

The inner product is no metric, so each vector v gets one more coordinate, sqrt(M^2 - |v|^2) with M
the largest norm, and a query gets 0 there: then |q - v|^2 = |q|^2 + M^2 - 2 q.v, and the nearest
vectors are those of the largest product, in the same order.

Vectors are dealt by hash over shards of bounded size. A shard's tree is bulk-loaded top down and
stored as pages, a row per node: routing object, covering radius, distance to the parent's routing
object, and the entries with their distances to the routing object. A search keeps a heap of nodes by
the least distance that any of their vectors can have; stored distances rule out children and entries
by the triangle inequality before a distance is computed. Bounds have a little slack for rounding and
only what is strictly worse is skipped, so ties are exact: scores are compared as integers.

Queries come in blocks; each shard answers each block with its own best k, and those merge.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Vectors of a shard and queries of a block on average; entries of a leaf page; children of a node.
SHARD, BLOCK, PAGE, CHILDREN = 16_384, 1_024, 256, 16
PAGES = "shard int, node int, parent int, leaf boolean, radius double, parent_distance double, routing binary, ids binary, vectors binary, distances binary"


@dataclass
class Node:
    routing: np.ndarray
    radius: float
    parent: int
    parent_distance: float
    ids: np.ndarray | None = None
    vectors: np.ndarray | None = None
    distances: np.ndarray | None = None
    children: list[int] = field(default_factory=list)


def quantise(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and floor(scale * x) as v, of rows whose vector is neither null nor holds null or non-finite components."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def build(ids: np.ndarray, vectors: np.ndarray, top: float) -> list[Node]:
    """A tree over integer vectors (rows); top: the largest squared norm of all shards."""
    held = vectors.astype(np.float64)
    held = np.concatenate([held, np.sqrt(np.maximum(top - (held**2).sum(axis=1), 0))[:, None]], axis=1)
    nodes: list[Node] = []
    todo = [(np.arange(len(ids)), -1)]
    while todo:
        rows, parent = todo.pop()
        own = held[rows]
        routing = own[np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        distance = np.sqrt(((own - routing) ** 2).sum(axis=1))
        to_parent = float(np.sqrt(((routing - nodes[parent].routing) ** 2).sum())) if parent >= 0 else 0.0
        at = len(nodes)
        nodes.append(Node(routing, float(distance.max(initial=0)), parent, to_parent))
        if parent >= 0:
            nodes[parent].children.append(at)
        if len(rows) <= PAGE:
            nodes[at].ids, nodes[at].vectors, nodes[at].distances = ids[rows], vectors[rows], distance
            continue
        pivots, near, nearest = [], np.full(len(rows), np.inf), np.zeros(len(rows), int)
        far = int(np.argmax(distance))
        for k in range(min(CHILDREN, -(-len(rows) // PAGE) + 1)):  # farthest first
            d = ((own - own[far]) ** 2).sum(axis=1)
            nearest, near = np.where(d < near, k, nearest), np.minimum(d, near)
            pivots.append(far)
            far = int(np.argmax(near))
            if near[far] <= 0:
                break
        parts = [rows[nearest == k] for k in range(len(pivots))]
        if max(map(len, parts)) > 0.9 * len(rows):  # one spot holds nearly all, as with equal vectors: cut by distance
            order = rows[np.argsort(distance, kind="stable")]
            parts = np.array_split(order, min(CHILDREN, -(-len(rows) // PAGE)))
        todo += [(p, at) for p in parts if len(p)]
    return nodes


def search(nodes: list[Node], query: np.ndarray, own_id: int, top: float, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) but those of own_id, best first; ties to the smaller id."""
    q = np.append(query.astype(np.float64), 0.0)
    norm = float((q**2).sum())
    best: list[tuple[int, int]] = []  # heap; the worst kept comes first: (score, -id)
    slack = 1e-6 * (1 + norm + top)

    def score_within(distance):
        return (norm + top - np.maximum(distance, 0) ** 2) / 2 + slack

    first = float(np.sqrt(((q - nodes[0].routing) ** 2).sum()))
    heap = [(max(0.0, first - nodes[0].radius), 0, first)]
    while heap:
        least, at, to_routing = heapq.heappop(heap)
        if len(best) == k and score_within(least) < best[0][0]:
            break
        node = nodes[at]
        if node.ids is None:
            for c in node.children:
                child = nodes[c]
                if len(best) == k and score_within(abs(to_routing - child.parent_distance) - child.radius) < best[0][0]:
                    continue
                d = float(np.sqrt(((q - child.routing) ** 2).sum()))
                heapq.heappush(heap, (max(0.0, d - child.radius), c, d))
            continue
        ids, vectors = node.ids, node.vectors
        if len(best) == k:
            open_ = score_within(np.abs(to_routing - node.distances)) >= best[0][0]
            if not open_.any():
                continue
            ids, vectors = ids[open_], vectors[open_]
        scores = vectors @ query
        if len(best) == k:
            keep = scores >= best[0][0]
            ids, scores = ids[keep], scores[keep]
        if len(ids) > k + 1:  # only the page's own best can enter; its ties stay
            cut = np.sort(scores)[-k - 1] if scores.dtype == object else np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
            if i == own_id:
                continue
            item = (int(s), -i)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


_WIDEST = 10**38 - 1


def _kind(top: float) -> type:
    """What inner products are exact in, given the largest squared norm, which bounds them all: doubles; int64, where
    sums that pass 64 bits on the way come back, as the result does not; Python's integers."""
    return np.float64 if top < 2.0**53 else np.int64 if top < 2.0**62 else object


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(column), width), kind)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def forest(vectors: DataFrame, count: int, width: int, top: float) -> DataFrame:
    """Pages of the trees of quantised vectors, a row per node."""
    held = np.float64 if _kind(top) is np.float64 else np.int64

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        nodes = build(ids[order], _matrix(group.column("v"), width, held)[order], top)
        shard = group.column("shard")[0].as_py()
        raw = lambda a: None if a is None else np.ascontiguousarray(a).tobytes()
        rows = [(shard, i, n.parent, n.ids is not None, n.radius, n.parent_distance, raw(n.routing), raw(n.ids), raw(n.vectors), raw(n.distances)) for i, n in enumerate(nodes)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in PAGES.split(", ")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    shards = max(1, -(-count // SHARD))
    return vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run, PAGES)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows by integer inner product.

    vectors: vec_id and embedding (array of numbers); other columns are ignored. is_query: a condition
    over vec_id. Vectors null or holding null or non-finite components, and rows of null id, take no part.
    Shorter vectors count as ending in zeros. Rows of the query's own id are not candidates; of queries
    with equal id the smallest vector asks. Fewer candidates than k: all. An empty table: no rows. Scores are exact
    and ranked as such up to 38 digits; one beyond a long is returned as the nearest long, and so is a component
    before products are made. Very long vectors, repeated rows and columns of any name are as others.
    """
    held = durable(quantise(vectors, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    whole = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("top"), F.count_if(is_query).alias("asked")).first()
    width, top = whole["width"] or 0, whole["top"] or 0.0
    kind = _kind(top)
    shards, blocks = max(1, -(-whole["n"] // SHARD)), max(1, -(-whole["asked"] // BLOCK))
    pages = durable(forest(held, whole["n"], width, top), "pages")
    asked = held.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q")).select(F.col("vec_id").alias("query_id"), "q")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = pages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            left = left.sort_by("node")
            get = lambda b, shape, of=np.float64: np.frombuffer(b, of).reshape(shape)
            nodes = []
            for r in left.to_pylist():
                node = Node(get(r["routing"], -1), r["radius"], r["parent"], r["parent_distance"])
                if r["leaf"]:
                    node.ids = get(r["ids"], -1, np.int64)
                    node.vectors, node.distances = get(r["vectors"], (len(node.ids), width), np.float64 if kind is np.float64 else np.int64).astype(kind, copy=False), get(r["distances"], -1)
                if node.parent >= 0:
                    nodes[node.parent].children.append(len(nodes))
                nodes.append(node)
            for query_id, q in zip(right.column("query_id").to_pylist(), _matrix(right.column("q"), width, kind), strict=True):
                out += [(query_id, i, Decimal(min(max(s, -_WIDEST), _WIDEST))) for s, i in search(nodes, q, query_id, top, k)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.decimal128(38, 0)), strict=True)})

    found = dealt.groupBy("shard", "part").cogroup(asked.groupBy("at", "block")).applyInArrow(run, "query_id long, vec_id long, score decimal(38,0)")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.least(F.greatest("score", F.lit(Decimal(-(1 << 63)))), F.lit(Decimal((1 << 63) - 1))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
