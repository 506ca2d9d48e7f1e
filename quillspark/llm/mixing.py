"""Mixing sources to target weights, exactly to budget.

Documents get hash-random keys (md5 of the id, or of the text where the id is null). Within a source they are dealt by key range: the keys
are uniform, so ranges of equal width hold equally many rows and a hot source has as many ranges as
it needs. Sums per (source, range) give each range's offset in its source; a running sum inside a
range then gives every document's place in the source's random order, with no task larger than a
range. The source is cut at its exact budget; a budget beyond the source repeats it from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

#: Rows that a key range holds on average.
RANGE_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0), key (uniform in [0, 2^32)), spread (the whole hash)."""
    spread = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")).cast("binary"))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), spread.alias("spread"), F.conv(F.substring(spread, 1, 8), 16, 10).cast("long").alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target for (source, source_size): a row per source, so a small table.

    Targets share `share` times all words by weight; one stops at `most` times its source's words and
    its excess is dealt again by weight. That level is found at once: in the order of
    most * size / weight, the first sources are full, and what remains is shared by the others' weights.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    one = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.lit(most) * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(most) * F.col("source_size")
    level = (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") <= full)
    cut = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return leveled.select("source", "source_size", F.round(F.least(full, F.col("weight") * F.coalesce(cut, F.lit(float("inf")))), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How much of every document row the mix takes.

    docs: doc_id, source, text; other columns are ignored, so they may have any name. Returns a row
    per row of docs: doc_id, source, size, source_size, target, taken. Sources are ordered by code
    point, null (a source of its own) last. taken counts words, repeats included, and is cut inside
    the document where the budget ends. Null text has size 0; very long texts are counted whole. Rows of equal id are taken in the order
    of size; ties are equal rows. An empty table gives an empty result. Reruns agree.
    """
    rows = durable(sized(docs), "sizes")
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    rows = rows.withColumn("span", F.floor(F.col("key") * F.lit(parts) / F.lit(1 << 32)))
    spans = rows.groupBy("source", "span").agg(F.sum("size").alias("words"))
    spans = durable(spans.select("source", "span", "words", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "spans")
    goal = targets(spans.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.select(F.col("source").alias("g"), "source_size", "target")
    plan = spans.select(F.col("source").alias("s"), F.col("span").alias("k"), "before").join(goal, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    inside = Window.partitionBy("source", "span").orderBy("spread", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("k")))
    budget, at = F.round("target").cast("long"), F.col("before") + F.col("inner")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - at))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))
