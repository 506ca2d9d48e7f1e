"""Paged sources as a Spark data source (A1-A8, J1): a partition a page, so tasks fetch, and retry, in parallel.

    spark.dataSource.register(PageSource)
    spark.read.format("paper_pages").option("source", "openalex").option("url", "https://...?q={query}&page={page}").option("query", "x").load()

A row is a record: its place in the source's answer, its year, and its text, wrapped as a page of one record, which the
mappers of connectors.py read. Filters on year go into the request ({year_from}, {year_to}); Spark applies them
again, so a source that ignores them gives the same result. As a stream, the offset is the number of pages read.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..tables import numbered, stored
from .connectors import MAPPERS, PAPER, SOURCES, with_retry

_SCHEMA = "page int, place int, year int, body string, error string"
# Where each source's answer holds its records (an Atom feed: its entries), and where a record holds its year.
RECORDS = {"openalex": ["results"], "crossref": ["message", "items"], "core": ["results"], "semantic_scholar": ["data"]}
YEARS = {"openalex": ["publication_year"], "core": ["yearPublished"], "semantic_scholar": ["year"]}
DATES = ["published-print", "published-online", "issued"]


@dataclass
class Page(InputPartition):
    number: int


def _year(source: str, record: dict) -> int | None:
    if source == "crossref":
        found = next((p[0] for c in DATES if (p := ((record.get(c) or {}).get("date-parts") or [None])[0])), None)
    else:
        found = record.get(YEARS[source][0])
    return found if isinstance(found, int) else None


def records(source: str, body: str) -> list[tuple[int | None, str]]:
    """(year, page of one record) of each record of a page."""
    if source == "arxiv":
        entries = re.findall(r"(?s)<entry>.*?</entry>", body)
        years = (re.search(r"<published>\s*(\d{4})", e) for e in entries)
        return [(int(y[1]) if y else None, f"<feed>{e}</feed>") for e, y in zip(entries, years, strict=True)]
    held = json.loads(body)
    for name in RECORDS[source]:
        held = (held or {}).get(name)
    wrap = lambda r: reduce(lambda inner, name: {name: inner}, reversed(RECORDS[source]), [r])
    return [(_year(source, r), json.dumps(wrap(r))) for r in held or []]


class _Pages:
    """What batch and stream share: the request of a page, with retries."""

    def __init__(self, options: dict[str, str]):
        self.source, self.url, self.query = options["source"], options["url"], options.get("query", "")
        self.size, self.limit = int(options.get("per_page", 100)), int(options.get("limit", 200))
        self.attempts, self.delay, self.timeout = int(options.get("attempts", 3)), float(options.get("delay", 1.0)), float(options.get("timeout", 30))
        self.year_from, self.year_to = (int(options[k]) if options.get(k) else None for k in ("year_from", "year_to"))

    def address(self, page: int) -> str:
        shown = lambda y: "" if y is None else str(y)
        return self.url.format(query=quote(self.query), page=page, offset=page * self.size, per_page=self.size, year_from=shown(self.year_from), year_to=shown(self.year_to))

    def fetch(self, page: int) -> list[tuple[int | None, str]]:
        def ask() -> tuple[int, str]:
            try:
                with urllib.request.urlopen(self.address(page), timeout=self.timeout) as answer:
                    return answer.status, answer.read().decode()
            except urllib.error.HTTPError as error:
                if error.code == 429:
                    return 429, ""
                raise

        status, body = with_retry(ask, self.attempts, self.delay)
        if status != 200:
            raise OSError(f"status {status}")
        return records(self.source, body)

    def rows(self, page: int) -> Iterator[tuple]:
        """A page's records; of a page that fails, the error alone, so that it never fails other pages, with a year that no filter drops."""
        try:
            found = self.fetch(page)[: max(0, self.limit - page * self.size)]
        except (OSError, ValueError, KeyError, AttributeError) as error:
            yield page, page * self.size, self.year_to if self.year_from is None else self.year_from, None, f"{type(error).__name__}: {error}"
            return
        for i, (year, body) in enumerate(found):
            yield page, page * self.size + i, year, body, None


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(-(-self.limit // self.size))]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition.number)


class _Filtered(_Batch):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on year go into the request. All filters are applied again, as a source may know years less well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("year",) and isinstance(getattr(f, "value", None), int):
                low = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f))
                high = {EqualTo: f.value, LessThanOrEqual: f.value, LessThan: f.value - 1}.get(type(f))
                if low is not None:
                    self.year_from = low if self.year_from is None else max(low, self.year_from)
                if high is not None:
                    self.year_to = high if self.year_to is None else min(high, self.year_to)
            yield f


class _Stream(_Pages, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.at, self.step = 0, int(options.get("pages_per_batch", 10))

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        """Pages that are there, up to a batch more than before; a page that is empty or fails is asked for again next time."""
        last = min(self.at + self.step, -(-self.limit // self.size))
        while self.at < last:
            try:
                if not self.fetch(self.at):
                    break
            except (OSError, ValueError):
                break
            self.at += 1
        return {"pages": self.at}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = max(self.at, end["pages"])
        return [Page(i) for i in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition.number)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["pages"])


class PageSource(DataSource):
    """Options: source, url (with {query}, {page}, {offset}, {per_page}, {year_from}, {year_to}), query, limit, per_page, attempts, delay, timeout; year_from, year_to, where no filter says it; pushdown ("true" where
    spark.sql.python.filterPushdown.enabled is set, which Spark demands of a reader that takes filters); of a stream pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "paper_pages"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Filtered(self.options) if self.options.get("pushdown") == "true" else _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def scan(spark: SparkSession, source: str, url: str, query: str, **options: object) -> DataFrame:
    """Records of one source: page, place, year, body, error. Year filters reach the request if the session lets Python sources take filters."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("paper_pages").option("pushdown", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()).option("source", source).option("url", url).option("query", query)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def papers(found: DataFrame, source: str) -> DataFrame:
    """The paper schema with page (the record's place) and item, in the source's own order; pages that failed give none."""
    return MAPPERS[source](found.where("body IS NOT NULL").select(F.col("place").alias("page"), "body"))


def before_error(found: DataFrame) -> DataFrame:
    """What came before the first page that failed, as asking page after page would give it."""
    first = found.agg(F.min(F.when(F.col("error").isNotNull(), F.col("page"))).alias("_first"))  # one row
    return found.crossJoin(F.broadcast(first)).where("_first IS NULL OR page < _first").drop("_first")


def search(spark: SparkSession, queries: str | dict[str, str], urls: dict[str, str | None], year_from: int | None = None, year_to: int | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """Papers of all sources with `ordinal`, and (source, status). Pages of all sources are fetched by tasks, each once.

    urls: source -> address; None for one without its key. One query goes to all sources. Records keep their source's
    order, sources that of SOURCES. A page that fails ends its source there and never fails others.
    """
    asked = {s: queries for s in SOURCES} if isinstance(queries, str) else queries
    frames, status = [], []
    for at, source in enumerate(SOURCES):
        if urls.get(source) is None:
            status.append(spark.range(1).select(F.lit(at).alias("_at"), F.lit(source).alias("source"), F.lit("skipped (no API key)").alias("status")))
            continue
        bounds = {k: v for k, v in (("year_from", year_from), ("year_to", year_to)) if v is not None}
        found = scan(spark, source, urls[source], asked.get(source, ""), **bounds, **options)
        if year_from is not None:
            found = found.where(F.col("year") >= year_from)
        if year_to is not None:
            found = found.where(F.col("year") <= year_to)
        found = stored(found, "pages")  # asked once, however often it is read
        kept = papers(before_error(found), source).withColumn("_at", F.lit(at))
        frames.append(kept)
        failed = found.agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("e"))
        n = kept.agg(F.count(F.lit(1)).alias("n"))
        status.append(failed.crossJoin(F.broadcast(n)).select(F.lit(at).alias("_at"), F.lit(source).alias("source"), F.when((F.col("n") == 0) & F.col("e").isNotNull(), F.concat(F.lit("error: "), F.col("e"))).otherwise(F.format_string("ok (%d results)", "n")).alias("status")))  # one row each
    said = reduce(DataFrame.unionByName, status).orderBy("_at").drop("_at")
    if not frames:
        return spark.createDataFrame([], PAPER), said
    every = numbered(reduce(DataFrame.unionByName, frames), [], ["_at", "page", "item"], "_n").withColumn("ordinal", F.col("_n") - 1)
    return every.select(*[c.split()[0] for c in PAPER.split(", ")]), said
