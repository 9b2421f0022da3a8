"""Every query with a DuckDB form gives the same rows in both engines."""

import os

import duckdb
import pandas as pd
import pytest

from quillstone import catalog

WHERE = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def rows(df: pd.DataFrame) -> list[str]:
    def cell(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return str(int(v)) if isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(WHERE):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{WHERE}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck):
    got, want = catalog.queries()[name](spark, WHERE).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(name, spark):
    assert catalog.queries()[name](spark, WHERE).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
