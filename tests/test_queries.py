"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(map(plain, r))) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, con, name):
    want, got = con.execute(catalogue.ORACLE[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


#: Queries without SQL that a test of their own holds against a plain version.
ELSEWHERE = {"hdbscan_labels", "hdbscan_recursive", "nonrigid_motion", "mixture_labels", "refined_mixture", "shaved_embeddings", "binned_peaks", "dipoles"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - ELSEWHERE))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
