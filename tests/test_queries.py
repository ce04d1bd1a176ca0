"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from paigham.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 7)
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(plain(v)) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, tables, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = tables.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 1
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).columns
