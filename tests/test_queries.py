"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillsieve import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert sorted(types) == cols and not [(c, k, types[c]) for c, k in df.dtypes if KINDS[k] != types[c]]
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.queries()) <= set(__spark_entry__.queries())
