"""Every query against its SQL in DuckDB, on the smallest tables, where they are there."""

import math
from pathlib import Path

import pytest

from stripchart.catalogue import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def plain(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return "null"
        if type(x).__name__ in ("bool", "bool_"):
            return str(bool(x))
        try:
            return repr(round(float(x), 5) + 0.0)
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(value, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        wanted = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert plain(found) == plain(wanted)
