"""Every query with SQL gives DuckDB's rows; the others run."""

import glob
import os

import duckdb
import pytest

from rxspark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(rows):
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = _rows(tuple(r) for r in df.select(*names).collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert rows == _rows(tuple(r[i] for i in order) for r in found.fetchall())


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 9
