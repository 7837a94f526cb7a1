"""Every query with SQL runs on Spark and on DuckDB over the same small tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from conftest import SF_SMALL

SPARK_FAMILY = {"int": "int32", "bigint": "int64", "double": "float64", "string": "string", "date": "date",
                "timestamp_ntz": "timestamp", "boolean": "bool"}
DUCK_FAMILY = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string", "DATE": "date",
               "TIMESTAMP": "timestamp", "BOOLEAN": "bool"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_SMALL):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return con


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted(tuple(_norm(x) for x in r) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in res.description}
    for f in df.schema.fields:  # same type family on both sides
        assert SPARK_FAMILY.get(f.dataType.simpleString(), "?s") == DUCK_FAMILY.get(dtypes[f.name], "?d"), f.name
    idx = [dcols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "spot_price" in df.columns
