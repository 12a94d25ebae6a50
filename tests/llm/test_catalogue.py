"""Every query of the subpackage that has SQL gives DuckDB's rows; SQL is text."""

import duckdb
import pytest

from lexmill.llm.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "labels")


def test_sql_is_text():
    assert set(ORACLES) <= set(QUERIES) and all(isinstance(x, str) for x in ORACLES.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns) and len(want)
    plain = lambda df: sorted(map(str, df[sorted(df)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
