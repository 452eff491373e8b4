"""Every query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import compare, connect
from tidemark.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_results_do_not_depend_on_partitioning(spark, duck):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for name in ("training_set", "event_state", "profit_curve"):
                assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
