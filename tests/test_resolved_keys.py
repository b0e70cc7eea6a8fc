"""Resolved references where keys have more digits than in the small tables, against their SQL."""

import duckdb
import pytest

from docweave.operators import references
from docweave.plans import reference_queries as q
from tests.test_oracles import rows_of

TABLES = ("region", "nation", "customer", "orders", "lineitem")
MORE = {"c_custkey": 900_000, "o_custkey": 900_000, "o_orderkey": 9_000_000, "l_orderkey": 9_000_000, "l_suppkey": 899_998, "l_partkey": 0}


@pytest.fixture(scope="module")
def large_keys(sf_dir, tmp_path_factory):
    """The smallest tables with keys of six digits and more; some suppliers have the number of a customer."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    for t in TABLES:
        columns = [r[0] for r in con.sql(f"DESCRIBE SELECT * FROM '{sf_dir}/{t}.parquet'").fetchall()]
        con.sql(f"COPY (SELECT {', '.join(f'{c} + {MORE[c]} AS {c}' if c in MORE else c for c in columns)} FROM '{sf_dir}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def test_numbers_of_acts_have_any_digits():
    text = "by Regulation (EU) 2016/60000 as amended by Directive 123456/7/EC"
    (found,) = references.references_in(text)
    assert dict(found["groups"]) == {"base_type": "regulation", "base_series": "eu", "base_number": "2016/60000", "by_type": "directive", "by_number": "123456/7", "by_suffix": "ec"}


def test_large_keys_against_sql(spark, large_keys):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{large_keys}/{t}.parquet'")
    got, want = q.resolved_references(spark, large_keys).toPandas(), con.sql(q.ORACLE_SQL["resolved_references"]).df()
    assert len(got) > 0 and rows_of(got, ["source", "type", "target"]) == rows_of(want, ["source", "type", "target"])
