"""Every query with SQL gives the rows of that SQL on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from foliomill.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list:
    def value(x):
        if x is None or not hasattr(x, "__len__") and pd.isna(x):
            return None
        return x if isinstance(x, str) else str(x) if isinstance(x, pd.Timestamp) else round(float(x), 9)

    return sorted(([value(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
