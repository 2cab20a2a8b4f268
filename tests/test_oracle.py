"""Every registered query with SQL agrees with it on the smallest tables, column by column."""

import os

import duckdb
import pandas as pd
import pytest

from ethospark.plans.queries import QUERIES
from ethospark.plans.sql import SQL

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) <= {
        "augment_plan_hash", "track_objects",
    }


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
