"""Every query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from docweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, engine, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    want = engine.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert len(got) == len(want)
    assert rows_of(got, columns) == rows_of(want, columns)
    assert len(got) > 0
