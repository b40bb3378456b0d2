"""Every registered query with an oracle against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumatile.plans import kernels, planted, relational  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)) and getattr(v, "ndim", 1):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, np.ma.core.MaskedConstant) or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else bool(v) if isinstance(v, np.bool_) else v


def rows(frame):
    columns = sorted(frame.columns)
    out = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(out, key=lambda t: [(str(type(x)), round(x, 4) if isinstance(x, float) else str(x)) for x in t])


def near(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(near, a, b))
    return abs(a - b) <= 2e-6 if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(relational.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    columns, mine = rows(relational.QUERIES[name](spark, SF).toPandas())
    expected_columns, expected = rows(duck.sql(relational.ORACLES[name]).df())
    assert columns == expected_columns
    assert len(mine) == len(expected)
    assert all(map(near, mine, expected))


@pytest.mark.parametrize("name", sorted(set(relational.QUERIES) - set(relational.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    first, second = (rows(relational.QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert first == second


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(relational.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
