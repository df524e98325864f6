"""Every query against its SQL counterpart, and every name registered."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x.isoformat() if isinstance(x, datetime.datetime) else x


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DIR), con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert dict(got.dtypes) == {c: KINDS.get(t, t) for c, t in types.items()}
    columns = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
