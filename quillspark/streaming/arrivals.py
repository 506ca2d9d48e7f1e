"""Duplicate records as papers arrive (D2, D3), whatever the order and the batches in which they come.

A folder holds three logs, one part a micro-batch: records as they came; labels, the merge log, which says what component
a record belongs to from that batch on; and changes, the merged records that a batch adds (+) and takes back (-). A batch
compares only titles of keys to which its papers bring something new, and folds only components that they join. Parts are
overwritten when a batch is run again, and a batch reads earlier parts only, so lost executors and restarts do no harm.
After any batches the current records are those that resolution.deduplicate gives for all papers at once, if nothing has expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators import resolution as rs
from ..sources.connectors import PAPER
from ..sources.store import complete
from ..tables import held, release, stored
from .events import ingest

_COLUMNS = [c.split()[0] for c in PAPER.split(", ")]
_SCHEMAS = {"records": PAPER, "labels": "id long, component long", "changes": f"op string, component long, {PAPER}"}


class Arrivals:
    """The logs under `path`, in a folder that all executors share.

    keep: a component that no paper has joined in so many batches is settled: later papers do not join it, its records stay.
    None: never. Papers without a title are left out. Ordinals name papers: of rows with one ordinal the first that
    arrives counts, in one batch the smallest. Columns beyond PAPER's are ignored.
    """

    def __init__(self, path: str, how: Config = DEFAULT, keep: int | None = None):
        self.path, self.how, self.keep = path, how, keep

    def _log(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame:
        """The log's rows and their batch, of complete batches before that number."""
        parts = [p for p in complete(spark, f"{self.path}/{name}", "batch=") if before is None or int(p.rsplit("=", 1)[1]) < before]
        schema = f"{_SCHEMAS[name]}, batch long"
        if not parts:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*parts)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def changes(self, spark: SparkSession) -> DataFrame:
        """op, component, the merged record and the batch, of all complete batches."""
        return self._log(spark, "changes")

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """component and merged record, after all complete batches, or those before a number."""
        log = self._log(spark, "changes", before)
        last = log.groupBy("component").agg(F.max("batch").alias("batch"))  # of a component taken back, that batch adds nothing
        return log.join(last, ["component", "batch"]).where("op = '+'").select("component", *_COLUMNS)

    def arrive(self, batch: DataFrame, number: int) -> None:
        """Adds a micro-batch of papers. Numbers rise; the last one may be run again."""
        spark, since = batch.sparkSession, held(batch.sparkSession)
        before = self._log(spark, "records", number).select(*_COLUMNS)
        others = [c for c in _COLUMNS if c != "ordinal"]
        one = rs.titled(batch).where("ordinal IS NOT NULL").groupBy("ordinal").agg(F.min(F.struct(*others)).alias("r")).select("ordinal", "r.*")
        self._write(one.join(before.select("ordinal"), "ordinal", "left_anti").select(*_COLUMNS), "records", number)
        new = spark.read.schema(PAPER).parquet(f"{self.path}/records/batch={number}")

        known = self._log(spark, "labels", number).groupBy("id").agg(F.max_by("component", "batch").alias("component"))
        if self.keep is not None:
            joined = self._log(spark, "changes", number).groupBy("component").agg(F.max("batch").alias("batch"))
            known = known.join(joined.where(F.col("batch") >= number - self.keep), "component", "left_semi")
        known = stored(known.select("id", "component"), "known")
        papers = before.join(known.select(F.col("id").alias("ordinal")), "ordinal", "left_semi").unionByName(new)

        label = rs.regroup(papers, known, self.how)
        self._write(label.join(known, ["id", "component"], "left_anti"), "labels", number)
        touched = label.join(new.select(F.col("ordinal").alias("id")), "id", "left_semi").select("component").distinct()
        members = stored(label.join(touched, "component", "left_semi"), "touched")
        gone = known.join(members.select("id"), "id", "left_semi").select("component").distinct()
        back = self.current(spark, number).join(gone, "component", "left_semi").withColumn("op", F.lit("-"))
        added = rs.folded(papers.join(members.select(F.col("id").alias("ordinal")), "ordinal", "left_semi"), members, self.how).withColumn("op", F.lit("+"))
        self._write(back.unionByName(added).select("op", "component", *_COLUMNS), "changes", number)
        release(spark, since)

    def run(self, papers: DataFrame, checkpoint: str) -> StreamingQuery:
        """Every micro-batch of a stream of papers; stops when the input is read. current() has the result."""
        return ingest(papers, self.arrive, checkpoint)
