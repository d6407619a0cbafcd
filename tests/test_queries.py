"""Every query with SQL against DuckDB at the smallest scale; the others must run and have rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanloom import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings predictions match_pairs length_examples kb_entities encoder_configs pack_specs mix_targets".split()


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_value, v))
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tz else v)
    return v


def _rows(df):
    return sorted((tuple(map(_value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    got = core.queries()[name](spark, SF).toPandas()
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_names():
    assert set(core.oracle_sql()) <= set(core.queries())
