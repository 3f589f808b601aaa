"""Every query with an SQL twin gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from siteglass.plans import registry

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF_DIR}/{f}')")
    return c


def plain(frame):
    """Rows as sorted text, numbers rounded, whatever their types."""

    def cell(x):
        if pd.isna(x) is True:
            return "-"
        return f"{float(x):.6f}" if isinstance(x, int | float) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x).removesuffix(" 00:00:00")

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
