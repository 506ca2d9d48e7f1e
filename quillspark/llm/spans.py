"""Where patterns match in whole texts, with DataFrame functions only.

Spark gives the matches of a pattern and the text between them, but no positions. The lengths of both,
summed along a text, are the positions: code points, end exclusive. Only documents with matches are
expanded, one row per match, and summed by a window over the document, so the work is linear in the
matches however many a document has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


@dataclass(frozen=True)
class Kind:
    """needs: a cheaper pattern that every text with a match has; group: group whose text is kept too."""

    name: str
    pattern: str
    needs: str
    group: int = 0


def locate(docs: DataFrame, kinds: list[Kind], context: int = 0, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, matches). rows: rid, doc_id and the columns to keep, one per row of docs. matches: rid, kind (its place in kinds),
    value, inner (the group's text), before and after (up to `context` characters around), start, end.
    """
    text = F.col("text").cast("string")

    def found(at: int, kind: Kind) -> Column:
        """Matches of one kind as an array of structs; empty where the text lacks what it needs."""
        values, inner = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
        between = F.split(text, kind.pattern, -1)
        gaps = F.transform(between, lambda p: F.struct(F.length(p).alias("n"), F.substring(p, -context, context).alias("b"), F.substring(p, 1, context).alias("a")) if context else F.struct(F.length(p).alias("n"), F.lit("").alias("b"), F.lit("").alias("a")))
        zipped = F.arrays_zip(values.alias("v"), inner.alias("i"), gaps.alias("g"), F.slice(gaps, 2, 1 << 30).alias("h"))
        made = F.transform(F.filter(zipped, lambda z: z["v"].isNotNull()), lambda z: F.struct(F.lit(at).alias("kind"), z["v"].alias("value"), z["i"].alias("inner"), z["g"]["n"].alias("gap"), z["g"]["b"].alias("before"), z["h"]["a"].alias("after")))
        return F.when(text.rlike(kind.needs), made)

    arrays = [F.coalesce(found(k, kind), F.array().cast("array<struct<kind:int,value:string,inner:string,gap:int,before:string,after:string>>")) for k, kind in enumerate(kinds)]
    rows = durable(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *keep, F.concat(*arrays).alias("found")), "spans")
    each = rows.where(F.size("found") > 0).select("rid", F.posexplode("found").alias("at", "m")).select("rid", "at", "m.*")
    along = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(along)
    placed = each.select("rid", "kind", "value", "inner", "before", "after", end.alias("end")).withColumn("start", F.col("end") - F.length("value"))
    return rows.drop("found"), placed


def listed(spans: DataFrame, names: list[str]) -> DataFrame:
    """rid, list: kind:start:end joined by commas, by start, then kind as in names, then end."""
    name = F.array(*[F.lit(n) for n in names])
    ordered = F.sort_array(F.collect_set(F.struct("start", "kind", "end")))
    return spans.groupBy("rid").agg(F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("list"))


def digest(rows: DataFrame, base: DataFrame, added: DataFrame, base_names: list[str], added_names: list[str]) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256, spans, for every row."""
    counts = base.groupBy("rid").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in enumerate(base_names)])
    both = base.select("rid", "kind", "start", "end").unionByName(added.select("rid", (F.col("kind") + len(base_names)).alias("kind"), "start", "end"))
    out = rows.join(counts, "rid", "left").join(listed(base, base_names).withColumnRenamed("list", "own"), "rid", "left").join(listed(both, [*base_names, *added_names]).withColumnRenamed("list", "spans"), "rid", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in base_names], F.sha2(F.coalesce("own", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
