"""Intermediate tables that are read more than once, as Parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (one machine), a temporary folder removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df and reads it back: work above it is done once, and survives lost executors. The files go with release(), or when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_forget, spark.sparkContext._jvm)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> int:
    """How many stored tables this application holds."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the stored tables from number `since` to `until`; results on them not yet consumed become unreadable."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    for path in paths[since:until]:
        _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    del paths[since:until]


def _delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _forget(jvm) -> None:
    """Deletes all that is left, and the application's folders; the session may be stopped, but the JVM still runs."""
    with contextlib.suppress(Exception):
        for path in [p for paths in _made.values() for p in paths]:
            _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), path)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """rows with `out`, their number from 1 by `order` within keys, without a task that holds a whole key.

    Rows are dealt by ranges of keys and order, numbered inside each range, and each range begins where the sum of those before it ends.
    Ties get some order, the same for all who read the result.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    sums = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    by = ", ".join(f"`{k}`" for k in keys)
    sums = sums.withColumn("_before", F.expr(f"sum(_n) OVER ({f'PARTITION BY {by} ' if keys else ''}ORDER BY _range) - _n"))  # a row per key and range
    sums = sums.select(F.col("_range").alias("_of"), "_first", "_before", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    on = F.col("_range") == F.col("_of")
    for c in same:
        on = on & c
    return placed.join(sums, on).withColumn(out, F.col("_before") + F.col("_row") - F.col("_first") + 1).select(*rows.columns, out)
