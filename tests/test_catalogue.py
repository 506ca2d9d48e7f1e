"""Every query against DuckDB on the same tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalogue, catalogue_reports  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def shown(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float | decimal.Decimal) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = db.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in got.columns]
    assert sorted(tuple(map(shown, r)) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
