"""Full texts and caches as files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store


def documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """paper_id, text of binary files that look like PDF; parse gives a file's pages, which are joined by
    line ends. A file that fails to parse gives no row."""
    files = spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 1024).cast("string").contains("%PDF"))
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("paper_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch.paper_id, batch.content, strict=True):
                try:
                    out.append((name, "\n".join(parse(content))))
                except Exception:  # noqa: BLE001  a broken file must not fail the scan
                    continue
            yield pd.DataFrame(out, columns=["paper_id", "text"])

    return rows.mapInPandas(run, "paper_id string, text string")


def fetched(papers: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """A10: paper_id, raw: what fetch(pdf_url) gives; null where it gives nothing or fails, so one paper never fails others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, url in zip(batch.paper_id, batch.pdf_url, strict=True):
                try:
                    out.append((key, fetch(url) or None))
                except Exception:  # noqa: BLE001  a download or a file may be broken in any way
                    out.append((key, None))
            yield pd.DataFrame(out, columns=["paper_id", "raw"])

    return papers.where(F.coalesce("pdf_url", F.lit("")) != "").select("paper_id", "pdf_url").mapInPandas(run, "paper_id string, raw string")


def text_cache(spark: SparkSession, path: str) -> Store:
    """The store of full texts by paper."""
    return Store(spark, path, "paper_id", "full_text")


def append_cache(rows: DataFrame, path: str) -> None:
    """Adds rows of (paper_id, full_text) to the text cache."""
    text_cache(rows.sparkSession, path).put(rows)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, one text per paper, the last that was written; empty where nothing was cached yet."""
    return text_cache(spark, path).read()


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as files of any Spark format."""
    rows.write.mode("overwrite").format(kind).save(path)
