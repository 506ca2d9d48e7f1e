import duckdb
import pytest

from quillspark.llm import queries
from tests.test_catalogue import TABLES, shown


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in got.columns]
    assert sorted(tuple(map(shown, r)) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
