"""Every query with SQL gives the rows that DuckDB gives for that SQL, at sf0.001."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerline.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return repr(float(v)) if not isinstance(v, (bool, str)) and hasattr(v, "__float__") else str(v)

    return sorted(str([cell(v) for v in row]) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, str(DATA)).toPandas()
    theirs = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
