"""A store of texts by key, as files that many may write at once.

A write is a folder of its own, cut into buckets by the key's hash, so writers never touch each other's files. Rows
carry the time of their write: of a key's rows the last one counts. Looking up keys reads their buckets only.
compact() makes one write of all that it saw and deletes those; what others add meanwhile stays.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Folders of writes under path that are complete."""
    where, files = _folder(spark, path)
    if not files.exists(where):
        return []
    found = [f.getPath() for f in files.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    return sorted(p.toString() for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _writes(spark: SparkSession, path: str) -> list[str]:
    return complete(spark, path, "write=")


class Store:
    """Text values under `path` by text key. key and value name the columns; a path is always used with the same number of buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", value: str = "value", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.value, self.buckets = spark, path, key, value, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        name = f"write={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def put(self, rows: DataFrame) -> None:
        """Adds rows; of a key given twice the larger value counts. Rows without key are left out."""
        own = rows.select(F.col(self.key).cast("string").alias(self.key), F.col(self.value).cast("string").alias(self.value)).where(F.col(self.key).isNotNull())
        self._write(own.groupBy(self.key).agg(F.max(self.value).alias(self.value)).withColumn("at", F.lit(time.time_ns())))

    def _rows(self, writes: list[str], buckets: list[int] | None = None) -> DataFrame:
        schema = f"`{self.key}` string, `{self.value}` string, at long, bucket int, write string"
        if not writes:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", self.path).parquet(*writes)
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(self.value, F.struct("at", "write")).alias(self.value))

    def read(self) -> DataFrame:
        """key, value: the last value of every key."""
        return self._last(self._rows(_writes(self.spark, self.path)))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value of those keys that are there. Reads the keys' buckets, which are at most `buckets` numbers here."""
        wanted = keys.select(F.col(self.key).cast("string").alias(self.key)).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]
        return self._last(self._rows(_writes(self.spark, self.path), buckets).join(wanted, self.key, "left_semi"))

    def compact(self) -> None:
        """One write in place of those there are now. A reader that began before may have to begin again."""
        old = _writes(self.spark, self.path)
        if len(old) > 1:
            self._write(self._rows(old).groupBy(self.key).agg(F.max(F.struct("at", "write", self.value)).alias("r")).select(self.key, f"r.{self.value}", "r.at"))
            for write in old:
                where, files = _folder(self.spark, write)
                files.delete(where, True)
