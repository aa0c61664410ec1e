"""Every registered engine query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind in "iufb":
            df[c] = df[c].astype(float)
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0 and len(set(got.columns)) == len(got.columns)
        assert not got.isna().all().any()
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = ordered(got), ordered(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[~same].head(), b[~same].head())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["t1", "t2", "lo", "hi", "n"] and df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
