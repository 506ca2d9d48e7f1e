"""Shared helpers of the training-data operators: tables, words, durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Cuts lineage: work above it survives lost executors, is done once however often it is read,
    and the optimiser sees true sizes. release() deletes the files; what is left goes when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_forget, spark.sparkContext._jvm)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> int:
    """How many durable tables this application holds."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes the durable tables from number `since` to `until`; results on them not yet consumed become unreadable."""
    held = _made.get(spark.sparkContext.applicationId, [])
    for path in held[since:until]:
        delete(spark, path)
    del held[since:until]


def _forget(jvm) -> None:
    """Deletes all that is left, at exit; the session may be stopped, but the JVM still runs."""
    with contextlib.suppress(Exception):
        for path in [p for held in _made.values() for p in held]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def hold_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")) / F.lit(float(1 << 53))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas.

    Without this the optimiser may put the defining expression in place of the name, and a lambda
    would then compute it again for each element.
    """
    return F.transform(F.array(value), body)[0]
