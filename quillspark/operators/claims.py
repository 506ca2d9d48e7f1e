"""Claim pairs, similarity networks, rule-based contradiction risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as tx
from ..tables import stored
from .blocks import Cells, codes, matrix

# Which way a term points.
POSITIVE = ["increase", "increases", "increased", "improve", "improves", "improved", "boost", "raise", "higher", "better", "outperform", "surpass", "succeed"]
NEGATIVE = ["reduce", "reduces", "reduced", "decrease", "decreases", "decreased", "drop", "drops", "decline", "declines", "worsen", "worse", "lower", "underperform", "lag", "fail"]
COMPARISONS = ["vs", "versus", "compared to", "relative to"]
NEGATIONS = ["not", "no", "never"]
CLASSES = ["Agreement", "Different Context", "Insufficient Evidence", "Partial Contradiction", "Contradiction"]
FLAGGED = ["Contradiction", "Partial Contradiction"]


#: Vectors of a block, on average: a task holds two blocks.
BLOCK = 16_384


def _products(left: pa.Table, right: pa.Table | None, group: str, ordinal: str, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of each pair of different groups and ordinals, once, with its inner product, and both sides' ordinals."""
    both = pa.concat_tables([left, right]) if right is not None else left
    groups, ids, n = codes(both.column(group)), both.column(ordinal).to_numpy(), left.num_rows
    a, b = (slice(0, n), slice(n, None)) if right is not None else (slice(0, n), slice(0, n))
    vectors = matrix(both.column(vector))
    ok = groups[a][:, None] != groups[b][None, :]
    ok &= ids[a][:, None] != ids[b][None, :] if right is not None else ids[a][:, None] < ids[b][None, :]
    rows, columns = np.nonzero(ok)
    return rows, columns, (vectors[a] @ vectors[b].T)[rows, columns], ids[a], ids[b]


#: Rows of a tile whose products are held at once where only figures of them are kept.
STRIP = 128


def _figures(left: pa.Table, right: pa.Table | None, group: str, ordinal: str, vector: str, least: float) -> pa.Table:
    """Lowest and highest inner product of the pairs of _products, null if there are none, and how many reach `least`; never more than STRIP rows of products are held."""
    other = left if right is None else right
    both = codes(pa.chunked_array([*left.column(group).chunks, *(right.column(group).chunks if right is not None else [])], left.schema.field(group).type))
    groups, others = both[: left.num_rows], both[-other.num_rows :] if other.num_rows else both[:0]
    ids, theirs, a, b = left.column(ordinal).to_numpy(), other.column(ordinal).to_numpy(), matrix(left.column(vector)), matrix(other.column(vector))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    low, high, over, some = np.inf, -np.inf, 0, False
    for at in range(0, len(a), STRIP):
        own = slice(at, at + STRIP)
        ok = groups[own][:, None] != others[None, :]
        ok &= ids[own][:, None] != theirs[None, :] if right is not None else ids[own][:, None] < theirs[None, :]
        if ok.any():
            product, some = a[own] @ b.T, True
            low, high = np.minimum(low, product.min(where=ok, initial=np.inf)), np.maximum(high, product.max(where=ok, initial=-np.inf))
            over += int(((product >= least) & ok).sum())
    return pa.table({"low": pa.array([float(low) if some else None], pa.float64()), "high": pa.array([float(high) if some else None], pa.float64()), "over": [over]})


def _whole(items: DataFrame, *columns: str) -> DataFrame:
    """These columns; rows that lack one pair with nothing."""
    return items.select(*columns).dropna()


def match_pairs(items: DataFrame, group: str, ordinal: str, vector: str, least: float, most: int | None = None) -> DataFrame:
    """Pairs a < b of different groups with inner product >= least; with `most`, the best only (ties by a, b).

    Exact: blocks against blocks, a matrix product a task; what passes leaves it, of `most` its own best. Blocks whose
    directions are too far apart to reach `least` never meet (see Cells).
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = f"a {kinds[ordinal]}, b {kinds[ordinal]}, group_a {kinds[group]}, group_b {kinds[group]}, similarity double"

    def compare(left: pa.Table, right: pa.Table | None) -> pa.Table:
        rows, columns, product, ids_a, ids_b = _products(left, right, group, ordinal, vector)
        hit = np.flatnonzero(product >= least)
        rows, columns, product = rows[hit], columns[hit], product[hit]
        swap = ids_a[rows] > ids_b[columns]
        low, high = np.where(swap, ids_b[columns], ids_a[rows]), np.where(swap, ids_a[rows], ids_b[columns])
        if most is not None and len(product) > most:
            best = np.lexsort((high, low, -np.round(product, 9)))[:most]
            rows, columns, product, swap, low, high = (x[best] for x in (rows, columns, product, swap, low, high))
        other = right if right is not None else left
        g, h = left.column(group).take(pa.array(rows)), other.column(group).take(pa.array(columns))
        mask = pa.chunked_array([pa.array(swap)])
        return pa.table({"a": low, "b": high, "group_a": pc.if_else(mask, h, g), "group_b": pc.if_else(mask, g, h), "similarity": product})

    cells = Cells(_whole(items, ordinal, group, vector), vector, ordinal, BLOCK)
    found = cells.compare(cells.bounds()[1] >= least, compare, schema)
    return found if most is None else top_pairs(found, most)


def top_pairs(pairs: DataFrame, most: int = DEFAULT.claim_pairs) -> DataFrame:
    """The most similar; similarities count to nine digits, so that the order of sums decides nothing."""
    return pairs.orderBy(F.desc(F.round("similarity", 9)), "a", "b").limit(most)


def possible_pairs(items: DataFrame, group: str) -> DataFrame:
    """Pairs of items of different groups, from the groups' sizes."""
    n = items.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("possible_pairs"))


def network_edges(pairs: DataFrame) -> DataFrame:
    """Edge width 1 + 3 * similarity."""
    return pairs.withColumn("width", 1 + 3 * F.col("similarity"))


def _polarity(text: Column) -> Column:
    """1, -1 by the first direction term; null without one."""
    first = F.get(F.filter(tx.alpha_tokens(text), lambda t: t.isin(*POSITIVE, *NEGATIVE)), 0)
    return F.when(first.isin(*POSITIVE), 1).when(first.isin(*NEGATIVE), -1)


def risk(topic_a: Column, topic_b: Column, claim_a: Column, claim_b: Column, similarity: Column) -> tuple[Column, Column]:
    """L1: (score, reason). Terms are added in this order, which decides the last bit."""
    a, b = F.lower(claim_a), F.lower(claim_b)
    both = F.concat(a, b)
    numbers = lambda c: c.rlike(r"\d")
    has = lambda marks: F.greatest(*[both.contains(m) for m in marks])
    rules = [
        (0.1, (topic_a != "") & (topic_b != "") & (F.lower(topic_a) == F.lower(topic_b)), "same topic"),
        (0.15, similarity >= DEFAULT.claim_similarity, "high similarity"),
        (0.55, _polarity(a) != _polarity(b), "opposite direction terms"),
        (0.05, numbers(a) & numbers(b), "numeric evidence"),
        (0.05, has(COMPARISONS), "comparison framing"),
        (0.03, has(NEGATIONS), "negation"),
    ]
    score = F.lit(0.0)
    for weight, rule, _ in rules:
        score = score + F.when(rule, F.lit(weight)).otherwise(0.0)
    said = F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for _, rule, name in rules])), "; ")
    return F.least(F.lit(1.0), score), F.when(said == "", "weak overlap").otherwise(said)


def predict(pairs: DataFrame) -> DataFrame:
    """L2: prediction, score (rounded after labelling) and reason for topic_a, topic_b, claim_a, claim_b, similarity."""
    score, reason = risk(*[F.col(c) for c in ("topic_a", "topic_b", "claim_a", "claim_b", "similarity")])
    label = F.when(F.col("_s") >= 0.8, "Likely Contradiction").when(F.col("_s") >= 0.6, "Possible Contradiction").otherwise("Low Risk")
    return pairs.withColumn("_s", score).withColumn("reason", reason).withColumn("prediction", label).withColumn("score", F.round("_s", 3)).drop("_s")


def by_index(rows: DataFrame, entries: DataFrame, index: str = "index") -> DataFrame:
    """Entries joined by 1-based index; of duplicates the last one wins."""
    last = entries.groupBy(index).agg(F.max_by("entry", "pos").alias("entry"))
    return rows.join(last, index, "left")


def zip_join(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Positional join, only if both have as many rows."""
    sizes = left.agg(F.count(F.lit(1)).alias("n")).crossJoin(right.agg(F.count(F.lit(1)).alias("m"))).where("n = m")  # one row
    return left.join(right, ordinal).crossJoin(F.broadcast(sizes)).drop("n", "m")


def flagged_papers(comparisons: DataFrame) -> DataFrame:
    """Papers of flagged pairs, once each."""
    flagged = comparisons.where(F.col("classification").isin(*FLAGGED))
    return flagged.select(F.explode(F.array("paper_a", "paper_b")).alias("paper")).distinct()


def class_summary(rows: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """A count for every class, also 0, and the total."""
    marks = F.array(*[F.struct(F.lit(c).alias("class"), F.count_if(F.col(column) == c).alias("n")) for c in classes], F.struct(F.lit("Total").alias("class"), F.count(F.lit(1)).alias("n")))
    return rows.agg(marks.alias("m")).select(F.explode("m").alias("m")).select("m.*")


def conflict_matrix(rows: DataFrame) -> DataFrame:
    """For each ordered pair of papers the most severe class; unknown classes count as insufficient."""
    code = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification")), F.lit(0)), F.lit(3))
    coded = rows.withColumn("code", code)
    both = coded.select(F.col("paper_a").alias("x"), F.col("paper_b").alias("y"), "code").unionByName(coded.select(F.col("paper_b").alias("x"), F.col("paper_a").alias("y"), "code"))
    return both.groupBy("x", "y").agg(F.max("code").alias("severity")).withColumn("classification", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("severity").cast("int")))


def flow_edges(rows: DataFrame, a: str, topic: str, b: str) -> DataFrame:
    """Paper -> topic and topic -> paper edges with their counts."""
    edges = rows.select(F.explode(F.array(F.struct(F.col(a).alias("source"), F.col(topic).alias("target")), F.struct(F.col(topic).alias("source"), F.col(b).alias("target")))).alias("e")).select("e.*")
    return edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def bubble(rows: DataFrame, category: str, confidence: str) -> DataFrame:
    """G11."""
    return rows.groupBy(category).agg(F.avg(F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))).alias("avg_confidence"), F.count(F.lit(1)).alias("n"))


def evidence_tree(rows: DataFrame) -> DataFrame:
    """Comparisons by class, with the severity to order them by, most severe first."""
    severity = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))
    return rows.groupBy("classification", severity.alias("severity")).agg(F.sort_array(F.collect_list("comparison")).alias("comparisons"))


def _pair_sums(items: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(sum of products, number) of all pairs of rows, each once, that differ in the last of keys and agree in the others, without making
    pairs: the square of a sum, less the squares of its parts. Ordinals that occur once only are in no such pair."""
    each = items.select(*keys, F.posexplode(vector).alias("_p", "_x"))
    part = each.groupBy(*keys, "_p").agg(F.sum(F.coalesce(F.col("_x").cast("double"), F.lit(0.0))).alias("_s"))
    total = part.groupBy(*keys[:-1], "_p").agg((F.pow(F.sum("_s"), 2) - F.sum(F.pow("_s", F.lit(2)))).alias("_d"))
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pairs = counts.groupBy(*keys[:-1]).agg((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))).alias("_d"))
    return total.agg((F.sum("_d") / 2).alias("sum")).crossJoin(F.broadcast(pairs.agg((F.sum("_d") / 2).cast("long").alias("n"))))  # one row each


def similarity_stats(items: DataFrame, group: str, ordinal: str, vector: str, least: float) -> DataFrame:
    """Lowest, mean and highest inner product of all pairs of different groups (and ordinals), and how many reach `least`.

    The mean comes from sums. The extremes are first looked for inside the cells; then only those cells meet whose pairs
    may lie beyond these, or reach `least`; each task keeps its own figures.
    """

    def compare(left: pa.Table, right: pa.Table | None) -> pa.Table:
        return _figures(left, right, group, ordinal, vector, least)

    held = stored(_whole(items, ordinal, group, vector), "items")
    cells = Cells(held, vector, ordinal, BLOCK)
    schema, own = "low double, high double, over long", np.eye(cells.cells.num_rows, dtype=bool)
    inside = stored(cells.compare(own, compare, schema), "inside")
    first = inside.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, high = cells.bounds()
    found = [unknown if x is None or np.isnan(x) else x for x, unknown in ((first.low, np.inf), (first.high, -np.inf))]
    beyond = (high >= least) | (low < found[0]) | (high > found[1])
    parts = inside.unionByName(cells.compare(beyond & ~own, compare, schema))
    again = held.join(held.groupBy(ordinal).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(ordinal), ordinal, "left_semi")
    mean = _pair_sums(held, [group], vector).alias("a").crossJoin(F.broadcast(_pair_sums(again, [ordinal, group], vector)).alias("b"))  # one row each
    mean = mean.select(F.try_divide(F.coalesce("a.sum", F.lit(0.0)) - F.coalesce("b.sum", F.lit(0.0)), F.coalesce("a.n", F.lit(0)) - F.coalesce("b.n", F.lit(0))).alias("mean"))
    return parts.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum("over"), F.lit(0)).alias("over")).crossJoin(F.broadcast(mean)).select("low", "mean", "high", "over")


def root_cause_edges(pairs: DataFrame) -> DataFrame:
    """An edge from either paper of a flagged pair to its root cause; with the papers' short labels."""
    side = lambda c: F.concat(F.lit("p::"), tx.short_label(F.col(c)))
    return pairs.select(F.explode(F.array(side("paper_a"), side("paper_b"))).alias("source"), F.concat(F.lit("c::"), F.col("root_cause")).alias("target"))


def per_group_counts(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """A count per group, 0 for those without rows."""
    return groups.select(key).distinct().join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").fillna({"n": 0})


def cap_per_group(rows: DataFrame, group: str, ordinal: str, most: int = DEFAULT.claims_per_paper) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(ordinal))).where(F.col("_n") <= most).drop("_n")
