"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from evidra.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in at)) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert found == rows(columns, want.fetchall())
    else:
        assert found
