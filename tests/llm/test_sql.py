"""The queries of the subpackage that have SQL, against it."""

import duckdb
import pytest

from docweave.llm import registry


def plain(value):
    """Nulls as None; whole numbers as int, as a column with nulls may hold floats."""
    if value is None or str(value) in ("<NA>", "nan", "NaT"):
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "clicks", "sales"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)
