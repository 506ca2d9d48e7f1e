"""Frequency tables, coverage, trends, clusters and what is made of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NOT_FOUND, NOT_REPORTED
from ..functions import text as tx
from ..tables import numbered, stored
from .blocks import matrix


def frequency(rows: DataFrame, category: Column, value: Column, ordinal: str) -> DataFrame:
    """Category, token, n, first; a token repeated in a row counts each time; rank by count, then first seen."""
    tokens = rows.select(category.alias("category"), F.col(ordinal).alias("o"), F.posexplode(tx.multi_values(value)).alias("p", "token"))
    counted = tokens.groupBy("category", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))
    ranked = numbered(counted, ["category"], [F.desc("n"), F.asc("first")], "rank")
    return ranked.select("category", "token", "n", F.col("rank").cast("int").alias("rank"))


def unpivot(rows: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """ordinal, category, value: a row per listed column."""
    return rows.unpivot([ordinal], columns, "category", "value")


def top_with_evidence(freq: DataFrame, total: int) -> DataFrame:
    """Each category's most common token with 'N of total papers'."""
    return freq.where("rank = 1").select("category", "token", F.format_string(f"%d of {total} papers", "n").alias("evidence"))


def highest_number(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """The row of the largest first number, ties to the first row; reported counts values without number too."""
    number = tx.first_number(F.col(value))
    best = F.max_by(F.struct(ordinal, value), F.when(number.isNotNull(), F.struct(number, -F.col(ordinal))))
    return rows.agg(best.alias("b"), F.count_if(~tx.is_missing(F.col(value))).alias("reported")).select(f"b.{ordinal}", f"b.{value}", "reported")


def coverage(rows: DataFrame, fields: list[str], families: dict[str, list[str]] | None = None) -> DataFrame:
    """Field, missing, reported, total; a family is missing where all its columns are."""
    missing = {f: tx.is_missing(F.col(f)) for f in fields} | {name: F.forall(F.array(*cols), lambda c: tx.is_missing(c)) for name, cols in (families or {}).items()}
    n = F.count(F.lit(1))
    made = F.array(*[F.struct(F.lit(f).alias("field"), F.count_if(m).alias("missing"), (n - F.count_if(m)).alias("reported"), n.alias("total")) for f, m in missing.items()])
    return rows.agg(made.alias("m")).select(F.explode("m").alias("m")).select("m.*")


def coverage_matrix(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """1 where reported."""
    return rows.select(key, *[F.when(tx.is_missing(F.col(f)), 0).otherwise(1).alias(f) for f in fields])


def trend(rows: DataFrame, year: Column, value: Column, ordinal: str, most: int = 6) -> DataFrame:
    """G6 in long form: year, token, n of the most frequent tokens (ties: first seen). The list of tokens is
    `most` rows, so it is broadcast."""
    tokens = rows.select(year.try_cast("int").alias("year"), F.col(ordinal).alias("o"), F.explode(tx.multi_values(value)).alias("token")).where("year IS NOT NULL")
    top = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("t"), F.min("o").alias("f")).orderBy(F.desc("t"), "f", "token").limit(most).select("token")
    return tokens.join(F.broadcast(top), "token").groupBy("year", "token").agg(F.count(F.lit(1)).alias("n"))


def landscape(rows: DataFrame, category: str, value: str, most: int = 12) -> DataFrame:
    """Totals for all, for each category (over all its values), and its `most` largest values."""
    made = rows.rollup(category, value).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    order = Window.partitionBy(category, "level").orderBy(F.desc("n"), value)
    return made.withColumn("at", F.row_number().over(order)).where((F.col("level") > 0) | (F.col("at") <= most)).drop("at")


#: Items of a table that one task takes after each other; clusters of a block that they are held against.
BATCH, BLOCK = 2048, 4096


def cluster(items: DataFrame, table: str, ordinal: str, vector: str, least: float) -> DataFrame:
    """Greedy clusters in order: an item joins the first cluster whose normalised running centroid it meets at
    `least` or more, else starts one. Adds `cluster`, by which each table's clusters are numbered from 0.

    Tables of up to BATCH items are folded whole, in parallel. Those of more go in rounds of BATCH items: in parallel, the items
    are held against all clusters as they stood before the round; then one task goes through the round's items in order, and needs
    only the clusters that some of them met, and those that the round itself has changed, for a cluster is first changed by an item that
    met it as it stood. So the order's result is exact, and no task holds more than a round.
    """
    held = stored(items.withColumn("_table", F.to_json(F.struct(F.col(table)))), "items")  # a null table is one of its own
    large = stored(held.groupBy("_table").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BATCH), "large")
    schema = T.StructType([*held.schema.fields, T.StructField("cluster", T.IntegerType())])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ordinal)
        sums, found = _Clusters(), []
        for v in group[vector]:
            found.append(sums.take(np.asarray(v, dtype=np.float64), least))
        return group.assign(cluster=np.array(found, dtype=np.int32))

    done = held.join(large, "_table", "left_anti").groupBy("_table").applyInPandas(fold, schema)
    most = large.agg(F.max("_n")).first()[0]
    if most is not None:
        done = done.unionByName(_rounds(held.join(large.select("_table"), "_table", "left_semi"), ordinal, vector, least, -(-most // BATCH)))
    return done.drop("_table")


class _Clusters:
    """Running sums of clusters, some of which may be left out, each with its number."""

    def __init__(self, first: int = 0):
        self.n, self.next = 0, first
        self.ids, self.sums = np.zeros(16, np.int64), np.zeros((16, 0))

    def add(self, number: int, v: np.ndarray) -> None:
        if self.sums.shape[1] < len(v):
            self.sums = np.pad(self.sums, ((0, 0), (0, len(v) - self.sums.shape[1])))
        if self.n == len(self.ids):
            self.ids, self.sums = np.pad(self.ids, (0, self.n)), np.pad(self.sums, ((0, self.n), (0, 0)))
        self.ids[self.n], self.sums[self.n, : len(v)] = number, v
        self.n += 1
        self.next = max(self.next, number + 1)

    def meets(self, v: np.ndarray, least: float) -> int | None:
        """The place of the first cluster, by number, that v meets."""
        sums = self.sums[: self.n]
        hits = np.flatnonzero((sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-8)) @ v >= least)
        return int(hits[np.argmin(self.ids[hits])]) if len(hits) else None

    def take(self, v: np.ndarray, least: float) -> int:
        """The number of the cluster that v joins or starts."""
        at = self.meets(v, least) if self.n else None
        if at is None:
            self.add(self.next, v)
            return self.next - 1
        self.sums[at] += v
        return int(self.ids[at])


_STEP = "_table string, kind int, rank long, cluster long, v array<double>"


def _rounds(held: DataFrame, ordinal: str, vector: str, least: float, rounds: int) -> DataFrame:
    """The clusters of tables of more than BATCH items, see cluster()."""
    spark = held.sparkSession
    ranked = stored(numbered(held, ["_table"], [ordinal], "_rank"), "ranked")
    vectors = ranked.select("_table", F.col("_rank").alias("rank"), F.col(vector).cast("array<double>").alias("v"))
    sums = spark.createDataFrame([], "_table string, cluster long, v array<double>")
    found = []
    none = lambda kind: F.lit(None).cast(kind)

    def against(asked: pa.Table, there: pa.Table) -> pa.Table:
        """Clusters that items may meet as they stand; a little more than those that they do, so that the last digit decides nothing."""
        name = asked.column("_table").slice(0, 1).to_pylist() if asked.num_rows else []
        if not asked.num_rows or not there.num_rows:
            return pa.table({"_table": pa.array([], pa.string()), "rank": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64())})
        a, b = matrix(asked.column("v")), matrix(there.column("v"))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        row, column = np.nonzero(a @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-8)).T >= least - 1e-9 * max(1.0, abs(least)))
        return pa.table({"_table": pa.array(name * len(row), pa.string()), "rank": asked.column("rank").take(pa.array(row)), "cluster": there.column("cluster").take(pa.array(column))})

    def step(rows: pa.Table) -> pa.Table:
        kinds, ranks, numbers, held_ = (rows.column(c).to_pylist() for c in ("kind", "rank", "cluster", "v"))
        name = rows.column("_table")[0].as_py()
        old, met, items_, first = {}, {}, [], 0
        for kind, rank, number, v in zip(kinds, ranks, numbers, held_, strict=True):
            v = np.array([x or 0.0 for x in v or ()])
            if kind == 0:
                items_.append((rank, v))
            elif kind == 1:
                met.setdefault(rank, []).append(number)
            elif kind == 2:
                old[number] = v
            else:
                first = number
        changed, out = _Clusters(first), []
        for rank, v in sorted(items_, key=lambda x: x[0]):
            at = changed.meets(v, least) if changed.n else None
            number = None if at is None else int(changed.ids[at])
            for c in sorted(met.get(rank, [])):
                if c in old and (number is None or c < number):
                    one = _Clusters()
                    one.add(c, old[c])
                    if one.meets(v, least) is not None:
                        changed.add(c, old.pop(c))
                        number, at = c, changed.n - 1
                        break
            if number is None:
                number = changed.next
                changed.add(number, v)
            else:
                changed.sums[at, : len(v)] += v
            out.append((name, 0, rank, number, None))
        out += [(name, 2, None, int(c), s.tolist()) for c, s in zip(changed.ids[: changed.n], changed.sums[: changed.n], strict=True)]
        cols = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("_table", "kind", "rank", "cluster", "v"), cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)})

    for r in range(rounds):
        now = vectors.where((F.col("rank") > r * BATCH) & (F.col("rank") <= (r + 1) * BATCH))
        blocks = sums.groupBy("_table").agg((F.floor(F.max("cluster") / BLOCK) + 1).cast("int").alias("_blocks"), (F.max("cluster") + 1).alias("_next"))
        asked = now.join(blocks, "_table").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        hits = stored(asked.groupBy("_table", "_block").cogroup(sums.groupBy("_table", F.floor(F.col("cluster") / BLOCK).cast("int").alias("_block"))).applyInArrow(against, "_table string, rank long, cluster long"), "hits")
        parts = [
            now.select("_table", F.lit(0).alias("kind"), "rank", none("long").alias("cluster"), "v"),
            hits.select("_table", F.lit(1).alias("kind"), "rank", "cluster", none("array<double>").alias("v")),
            sums.join(hits.select("_table", "cluster").distinct(), ["_table", "cluster"], "left_semi").select("_table", F.lit(2).alias("kind"), none("long").alias("rank"), "cluster", "v"),
            blocks.join(now.select("_table").distinct(), "_table", "left_semi").select("_table", F.lit(3).alias("kind"), none("long").alias("rank"), F.col("_next").alias("cluster"), none("array<double>").alias("v")),
        ]
        done = stored(reduce(DataFrame.unionByName, parts).groupBy("_table").applyInArrow(step, _STEP), "round")
        fresh = done.where("kind = 2").select("_table", "cluster", "v")
        found.append(done.where("kind = 0").select("_table", F.col("rank").alias("_rank"), F.col("cluster").cast("int").alias("cluster")))
        sums = stored(sums.join(fresh, ["_table", "cluster"], "left_anti").unionByName(fresh), "clusters")
    return ranked.join(reduce(DataFrame.unionByName, found), ["_table", "_rank"]).drop("_rank")


def gap_table(clustered: DataFrame, keys: list[str], ordinal: str, text: str, paper: str) -> DataFrame:
    """Per cluster its statements (not papers) as frequency, sorted papers, and `gap`, the first member's text."""
    return clustered.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("frequency"), F.array_join(F.array_sort(F.collect_set(paper)), ", ").alias("papers"), F.substring(F.min_by(text, ordinal), 1, 120).alias("gap")
    )


def problem_table(rows: DataFrame, problem: str, paper: str, technique: str, model: str, metrics: dict[str, str]) -> DataFrame:
    """Per problem distinct papers, techniques and models (case-insensitively, first spelling, by paper), best
    performance, supporting papers, diversity of solutions.

    metrics: name -> column, in order. The best is the largest first number, as 'value (name)'; ties to the first
    paper, then metric.
    """
    listed = lambda c: F.array_sort(F.collect_set(F.struct(F.col(paper).cast("string").alias("p"), F.col(c).alias("v"))))
    told = F.array_compact(F.array(*[F.when(~tx.is_missing(F.col(c)) & tx.first_number(F.col(c)).isNotNull(), F.struct((-tx.first_number(F.col(c))).alias("n"), F.col(paper).cast("string").alias("p"), F.lit(i).alias("i"), F.concat(F.col(c), F.lit(f" ({name})")).alias("v"))) for i, (name, c) in enumerate(metrics.items())]))
    agg = rows.withColumn("_told", F.array_min(told)).groupBy(problem).agg(
        F.count_distinct(paper).alias("frequency"), listed(technique).alias("t"), listed(model).alias("m"), F.array_join(F.array_sort(F.collect_set(F.col(paper).cast("string"))), ", ").alias("papers"), F.min("_told").alias("b")
    )
    values = lambda c: tx.dedupe_terms(F.flatten(F.transform(c, lambda x: F.coalesce(tx.multi_values(x["v"]), F.array().cast("array<string>")))))
    out = agg.withColumn("techniques", values(F.col("t"))).withColumn("models", values(F.col("m")))
    lower = F.array_distinct(F.transform(F.concat("techniques", "models"), F.lower))
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NOT_FOUND)
    return out.select(problem, "frequency", shown("techniques").alias("techniques"), shown("models").alias("models"), F.coalesce("b.v", F.lit("No reported performance metric")).alias("best"), "papers", F.size(lower).cast("long").alias("diversity"))


# Rows of the summary, and what it says without data.
SUMMARY = ["Most Common Research Problem", "Most Used AI Technique", "Most Used AI Model", "Problem With Most Proposed Solutions", "Problem That Remains Least Solved"]
NO_DATA, NOT_IN_PAPERS = "No data available", "Not reported in evaluated papers"


def problem_summary(table: DataFrame, problem: str, ordinal: str, overall: DataFrame) -> DataFrame:
    """Category, value. The most frequent problem and those of most and least diverse solutions, ties to the row of
    least `ordinal`; the most used technique and model from overall (category, common), which may lack them."""
    best = lambda c, sign: F.max_by(F.col(problem), F.struct(sign * F.col(c), -F.col(ordinal)))
    figure = lambda c, f, unit: F.concat(c, F.lit(" ("), f.cast("string"), F.lit(f" {unit})"))
    usable = lambda name: F.max(F.when(F.col("category") == name, F.when(F.coalesce(tx.strip(F.col("common")), F.lit("")).isin("", NOT_FOUND, NOT_REPORTED), NOT_IN_PAPERS).otherwise(F.col("common"))))
    used = overall.agg(*[F.coalesce(usable(n), F.lit(NOT_FOUND)).alias(f"_{i}") for i, n in enumerate(SUMMARY) if i in (1, 2)])  # one row
    made = table.agg(
        figure(best("frequency", 1), F.max("frequency"), "papers").alias("_0"), figure(best("diversity", 1), F.max("diversity"), "distinct techniques/models").alias("_3"),
        figure(best("diversity", -1), F.min("diversity"), "distinct techniques/models").alias("_4"), F.count(F.lit(1)).alias("_n"),
    ).crossJoin(F.broadcast(used))  # one row each
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.when(F.col("_n") > 0, F.col(f"_{i}")).otherwise(NO_DATA).alias("value")) for i, n in enumerate(SUMMARY)])
    return made.select(F.explode(rows).alias("m")).select("m.*")


def chips(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Key, chips: the values of several fields as single tokens, in order; a value of separators alone stays whole."""
    value = lambda f: F.when(tx.is_missing(F.col(f)), F.array().cast("array<string>")).otherwise(F.when(F.size(tx.multi_values(F.col(f))) > 0, tx.multi_values(F.col(f))).otherwise(F.array(tx.strip(F.col(f)))))
    return rows.select(key, F.concat(*map(value, fields)).alias("chips"))


def tag_cloud(freq: DataFrame, count: str) -> DataFrame:
    """Size 0.82 + 1.18 c / max, opacity 0.5 + 0.5 c / max. The maximum is aggregated first: one row."""
    top = freq.agg(F.max(count).alias("_top"))
    share = F.col(count) / F.col("_top")
    return freq.crossJoin(F.broadcast(top)).select(*freq.columns, F.round(0.82 + 1.18 * share, 6).alias("size"), F.round(0.5 + 0.5 * share, 6).alias("opacity"))


def bar_order(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """I4: rows of a chart with `at`, their place by ascending value, ties in input order."""
    return rows.withColumn("at", F.row_number().over(Window.orderBy(value, ordinal)))  # a chart's bars


def context_size(rows: DataFrame, section: str, text: str) -> DataFrame:
    """A quarter of the characters per section."""
    return rows.groupBy(section).agg(F.floor(F.sum(F.length(text)) / 4).alias("tokens"))


def missing_as_sentinel(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NOT_FOUND))
