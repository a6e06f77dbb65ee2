import duckdb
import pytest
from lumenfold.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=str)
    assert sorted(got.columns) == columns and rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())
