"""Every query of the image library against its SQL in DuckDB, or against brute force."""

import os

import duckdb
import pytest

from rasterloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, base, name):
    df = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert _rows(df.collect()) == _rows(base.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(0 <= r["b0"] <= 255 for r in rows)
