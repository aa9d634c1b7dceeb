"""Every registered query against its oracle SQL, on the smallest tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from lodestar.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, (int, np.integer)) and not isinstance(x, bool):
        return repr(float(x))
    if isinstance(x, (float, np.floating)):
        return "null" if math.isnan(x) else repr(round(float(x), 8) + 0.0)
    return str(x).removesuffix(" 00:00:00")


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(zip(*([plain(x) for x in frame[c].tolist()] for c in columns), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["n_name", "o_year", "c_custkey", "revenue", "n_orders", "rk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
