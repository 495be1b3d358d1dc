"""Every query with an oracle against DuckDB on the smallest tables, where these are there."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from corpusmill.plans import catalogue

FOLDER = __spark_entry__.SMOKE_DIR
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return c


def shown(rows):
    return sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) for v in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == names
    assert shown([[r[n] for n in names] for r in got.collect()]) == shown(duck.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalogue.ORACLES[name]})").fetchall())


@needs_tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert catalogue.file_inventory(spark, FOLDER).count() >= 10


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
