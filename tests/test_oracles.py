"""Every query with an SQL twin gives the twin's rows."""

import math
import os

import duckdb
import pytest

from samewise.plans import queries as Q

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"]


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF)
    names = sorted(got.columns)
    assert sorted(rel.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    want = sorted(map(plain, con.sql(f"SELECT {quoted} FROM ({Q.oracle_sql()[name]})").fetchall()), key=str)
    assert sorted((plain(r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=str) == want
