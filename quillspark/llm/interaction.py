"""How filters act beside each other: what each removes, in every order.

One scan turns each document into a mask, a bit for each filter that it fails; the bit of the filter
against copies comes from a grouping by text, which gives the smallest doc_id of each text. Masks are
summed to a histogram of at most 2^n cells a part, and all orders are read off the cells, so the
documents are not touched again. DataFrame functions only.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, let

#: Letter of a filter -> SQL for when a document fails it, over text, n_words, n_distinct, n_capitals and n_chars.
RULES = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_capitals > 10 * n_chars", "D": "text RLIKE '[#$%&*|]'"}
#: Letter of the filter that fails a text which a smaller doc_id has too.
COPIES = "E"


def masks(docs: DataFrame, rules: dict[str, str] = RULES, part: str = "lang") -> DataFrame:
    """doc_id, part, digest (sha-256 of the text) and mask: bit k for the k-th rule failed. A row per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("w"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"), F.length(text).cast("long").alias("n_chars"))
    measured = own.select("doc_id", "part", "text", F.col("w.n").alias("n_words"), F.col("w.d").alias("n_distinct"), "n_capitals", "n_chars")
    mask = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, rule in enumerate(rules.values())), F.lit(0))
    return measured.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, the copies' bit above the rules'. At most 2^n rows a part.

    Rows of one text, part and labels are summed before texts are compared, so a text that a third of
    all rows have is a few rows by then.
    """
    ones = lambda c: F.coalesce(c == 1, F.lit(False))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(ones(F.min("quality")).alias("good"), ones(F.max("toxic")).alias("toxic"))
    rows = masks(docs, rules, part).join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    each = rows.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("c"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("c")).otherwise(0)
    texts = durable(each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("c").alias("n"), F.sum(known).alias("known"), F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("n_first")), "texts")
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    copies = F.col("known") - F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    told = texts.join(least, "digest").withColumn("copies", copies)
    both = told.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), F.col("copies").alias("n")))).alias("m")).select("part", "good", "toxic", "m.*")
    over = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), over("good").alias("good"), over("toxic").alias("toxic"))


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and what the step's filter does, for every order of the letters, read off the cells of a part."""
    many, bits = len(letters), [F.lit(1 << k) for k in range(len(letters))]
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = held.select("part", "cells", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")).select("*", F.explode(F.array(*[F.lit(i) for i in range(1, many + 1)])).alias("step"))
    own = F.element_at(F.array(*bits), F.instr(F.lit(letters), F.col("filter_order").substr(F.col("step"), F.lit(1))))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), b).otherwise(0) for c, b in zip(letters, bits, strict=True)), F.lit(0))
    asked = steps.select("part", "cells", "filter_order", "step", own.alias("own"), before.alias("before"))

    def over(what: str, hit) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(hit(c["mask"]), c[what]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    # in a share 1 / k of all orders, a filter is the first of the k that a document fails
    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c["mask"]), c["n"] * F.get(F.array(*[F.lit(factorial(many) // k) for k in range(1, many + 1)]), F.bit_count(c["mask"]) - 1)).otherwise(0))
    return asked.select(
        "part", "filter_order", "step", over("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), over("n", removed).alias("removed"), over("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        over("n", lambda m: m == F.col("own")).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, copies: str = COPIES, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text and the part's column; labels: doc_id, quality (1 good), toxic (1 toxic); other columns
    are ignored, so they may have any name. A null text counts as empty, a null part as the empty one. A row
    without doc_id is no copy, and no row is a copy of it; rows of one doc_id and text are no copies of each
    other, each counts. A document labelled more than once is good if all its labels say so, toxic if any does.
    Texts are read whole. An empty table gives an empty result; without labels good_lost and toxic_lost are 0.
    """
    return orders(histogram(docs, labels, rules, part), "".join([*rules, copies]))
