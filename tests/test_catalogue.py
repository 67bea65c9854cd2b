"""Every registered raster query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from terradelta.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted((tuple(round(float(x), 5) if isinstance(x, float) else None if x is None or x is pd.NA else str(x) if isinstance(x, str) else round(float(x), 5) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
