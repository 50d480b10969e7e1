"""Every registered query of the engine against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from basaltine.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
