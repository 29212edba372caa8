"""The registered queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from mapweave.llm.queries import ORACLE, QUERIES
from oracle_check import mismatch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert mismatch(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()) is None


def test_every_operator_is_registered():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
