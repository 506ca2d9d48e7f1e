"""Awkward tables that every operator must survive."""

from pyspark.sql import DataFrame, SparkSession

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix strong potions near old stone walls".split()


def words(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(seed + i * i * 7 + i) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def awkward(spark: SparkSession, extra: str = "") -> DataFrame:
    """Nulls in every column, empty, blank and long texts, repeated rows, clashing names in `extra`."""
    rows = [
        (1, words(80, 1), "en", "a"), (2, words(80, 1), "en", "a"), (2, words(80, 1), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "de", "b"),
        (6, "one", "fr", "c"), (None, words(60, 5), "en", "a"), (7, words(60_000, 7), None, "a"), (8, "x" * 200_000, "en", "z"), (9, "\U0001f600 é     ß", "de", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in extra.split():
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
