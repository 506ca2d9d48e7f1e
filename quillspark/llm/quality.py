"""Quality rules with risk-controlled cutoffs.

Each rule compares a figure of the text with a cutoff. Cutoffs are not chosen by hand: all rules have a ladder
of levels, from lenient to strict, fixed beforehand. Over labelled holdout rows, in each stratum, a level is
safe if the exact binomial (Clopper-Pearson) bound on its rate of false rejections, the good documents that
any rule drops at that level, is at most the risk allowed. Levels are tested from the most lenient on until
one fails (fixed-sequence testing, which spends no error on the order); Bonferroni's correction covers the
strata. The strictest safe level holds, for all rules together; without one, nothing is rejected in that
stratum. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, let

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Risk:
    """False rejections allowed among good documents of a stratum, by all rules together; chance that the bound is wrong."""

    allowed: float = 0.03
    error: float = 0.05


#: Rule -> its cutoff at each level, from lenient to strict; a figure at or above the cutoff is rejected.
RULES = {
    "symbols": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "duplicate_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeated_words": (0.45, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "word_length": (30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0),
}
LEVELS = 8


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; equal 64-bit hashes of three words count as equal."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.sort_array(F.transform(twin, lambda x: x["p"]))
            zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), of_sorted))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(windows, of_hashes))

    return let(words, of_words)


def duplicate_lines(text: Column) -> Column:
    """(lines with a word, those equal to an earlier one) as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(WORD))
    return let(lines, lambda l: F.struct(F.size(l).alias("lines"), (F.size(l) - F.size(F.array_distinct(l))).alias("dups")))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum (null: empty), the base figures and the rules' figures of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("l"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    return base.select("doc_id", "stratum", "w.n_words", "word_chars", "n_symbols", F.col("l.dups").cast("long").alias("n_dup_lines"), "w.n_repeat_words", "n_capitals", F.col("l.lines").cast("long").alias("n_lines"))


def figures() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbols": share("n_symbols", "n_words"), "duplicate_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"), "word_length": share("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_at_most(x: Column, n: Column, rate: float) -> Column:
    """P(B <= x) for B ~ Binomial(n, rate), summed exactly in logarithms."""
    zero = let_struct(n * math.log1p(-rate))
    odds = math.log(rate / (1 - rate))

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.ln((n - i + 1).cast("double") / i) + odds
        return F.struct(term.alias("t"), (F.greatest(a["s"], term) + F.ln(1 + F.exp(-F.abs(a["s"] - term)))).alias("s"))

    ids = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(ids, zero, step, lambda a: F.exp(a["s"]))


def let_struct(first: Column) -> Column:
    return F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))


def levels(rows: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """stratum and its strictest safe level, from 1 (0: none). A row per stratum with good labels."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = rows.where(~base_failed()).join(good, "doc_id")  # what the base drops is not the rules' doing
    fig = figures()
    hit = [reduce(or_, [fig[r] >= cs[k] for r, cs in RULES.items()]) for k in range(LEVELS)]
    by = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(h).alias(f"x_{k}") for k, h in enumerate(hit)])
    strata = by.agg(F.count(F.lit(1)).alias("strata"))
    p = [F.when(F.col(f"x_{k}") <= F.col("n") * risk.allowed, binomial_at_most(F.col(f"x_{k}"), F.col("n"), risk.allowed)).otherwise(1.0) for k in range(LEVELS)]
    safe = F.array(*[x <= F.lit(risk.error) / F.col("strata") for x in p])
    tested = by.crossJoin(F.broadcast(strata)).select("stratum", F.array_position(safe, False).alias("fail"))  # strata is one row
    return tested.select("stratum", F.when(F.col("fail") == 0, LEVELS).otherwise(F.col("fail") - 1).cast("int").alias("level"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and what rejected.

    docs: doc_id, text and the stratum's column; labels: doc_id, quality (1 good); other columns are
    ignored. Null text has no words and fails the base. A null stratum is a stratum of its own. A
    document labelled more than once counts as good only if all its labels are. Without labels no rule
    rejects. Very long texts are read whole. Repeated rows are each judged. An empty table gives an empty result.
    """
    rows = durable(measures(docs, stratum), "measures")
    joined = rows.join(durable(levels(rows, labels, risk), "levels"), "stratum", "left")
    cutoff = lambda r: F.when(F.col("level") > 0, F.element_at(F.array(*map(F.lit, RULES[r])), F.col("level")))
    hits = F.array_compact(F.array(*[F.when(f >= cutoff(r), F.lit(r)) for r, f in figures().items()]))
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size(hits) == 0)).alias("kept"), F.array_join(hits, ",").alias("rejected_by"))
