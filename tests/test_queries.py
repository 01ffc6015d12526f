"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from conftest import SMALL
from kvloom import queries


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SMALL):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return db


def rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object)
    return columns, sorted(map(str, values.where(values.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert queries.entry(spark).count() == 20
