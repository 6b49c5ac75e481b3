"""Every registered query of the reference operators against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from flowspark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: checked in test_truths.py
ELSEWHERE = {"d07_rf_importance", "f12_ablation_report", "m20_retrain_chain"}


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool):
        return x
    try:
        return round(float(x), 6) + 0.0
    except (TypeError, ValueError):
        return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - ELSEWHERE))
def test_query(spark, duck, data, name):
    df = plans.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name not in plans.ORACLE_SQL:
        assert got
        return
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
