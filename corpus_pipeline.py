"""The corpus pipeline: toxicity, near-duplicates, personal data, source mix, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. run() applies them to the table documents. Tables of other names come from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, near_dedup, packing, pii, toxicity
from quillspark.llm.common import durable, hold_out, made, release, table

#: Packing cannot be expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.7 stay, as they are. Labels of ids with crc32 mod 3 of 1 are never learned from.

    Null and empty texts score as texts without marks; texts are read whole; repeated rows go or stay
    together; columns may have any name; an empty table stays empty; without labels all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), hold_out(F.col("doc_id"), 3) != 1)
    return docs.where(toxicity.scorer(docs, model)(F.col("text").cast("string")) < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id. Five words, similarity 0.8.

    Documents without words, or without id, have no copies and stay. Rows of one id are one document: of
    them the first by text, then by the other columns, stays, so reruns agree. Texts are read whole;
    columns may have any name; an empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs, near_dedup.Plan(words=5, percent=80))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = found.where("doc_id IS NOT NULL AND kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.struct(F.col("text").cast("string"), F.to_json(row))).alias("__row")
    twice = left.join(again, F.col("doc_id") == F.col("__again")).groupBy("__again").agg(first).select("__row.*")
    return left.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(twice)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; spans of personal data become their kind in brackets, n_chars the new length.

    Null texts stay null, with n_chars null; empty and very long ones, repeated rows, ties of spans, an
    empty table and columns of any name are as pii.sanitise says.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its share of 150 % of all words: a row for each time that the mix takes the document.

    A document that the budget cuts is taken whole if the cut leaves half of it or more. Documents
    without words, and rows without id, are taken once. Rows of one id are all taken as often as the one
    taken most. A null source is a source of its own. Texts are counted whole; columns may have any
    name; an empty table stays empty.
    """
    taken = mixing.mix(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)).alias("__times"))
    joined = docs.join(taken, F.col("doc_id") == F.col("__id"), "left").withColumn("__times", F.coalesce("__times", F.lit(1)))
    return joined.where("__times > 0").withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; null and long texts, repeated rows, empty tables and other columns as packing.pack says."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", mask_personal_data), ("source_mix", mix_sources), ("best_fit_pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents. A stage's output goes once the next one's is written;
    the last one, which the result still reads, when Python exits."""
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        release(spark, before, -1)
    return STAGES[-1][1](spark, docs, sf_dir)
