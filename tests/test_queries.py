"""Every registered query against its SQL at the smallest scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES


@pytest.fixture(scope="module")
def database(small_dir):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, small_dir, database, name):
    if name not in entry.oracle_sql():
        pytest.skip("not expressible in SQL; compared with a plain version in tests/llm")
    frame = entry.queries()[name](spark, small_dir)
    found = database.execute(entry.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == sorted(frame.columns)
    assert Counter(map(tuple, frame.select(*order).collect())) == Counter(found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
