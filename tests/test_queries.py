"""Every query runs, and returns what its SQL returns in another engine."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quarry import plans
from quarry.session import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "year"):
        return str(v)[:19].removesuffix(" 00:00:00")
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        x = float(v)
        return x if math.isinf(x) else round(x, 6) + 0.0
    return v


def table(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER).toPandas()
    if name in plans.oracle_sql():
        assert table(got) == table(duck.sql(plans.oracle_sql()[name]).df())
