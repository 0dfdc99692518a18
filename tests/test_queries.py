"""Every query of the core against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from thicket.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    d = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        d.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return d


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 7) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(map(norm, r)) for r in duck.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()), key=str)


def test_sql_names():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
