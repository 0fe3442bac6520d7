"""Every registered query against DuckDB on the test tables."""

import os

import pytest
from oracle_check import compare

import __spark_entry__ as contract
from pastlane.plans.catalog import QUERIES
from pastlane.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# One slot of one day, and half of the region, can be empty at the smallest scale.
MAY_BE_EMPTY = {"fetched_slot_join", "default_mode_join", "unexpired_at_the_last_row"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(contract.queries()) >= set(contract.oracle_sql()) >= set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, name):
    rows = compare(contract.queries()[name](spark, SF_DIR), contract.oracle_sql()[name], SF_DIR)
    assert rows > 0 or name in MAY_BE_EMPTY


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(name for name in QUERIES if "stream" not in name))
def test_plans_without_broadcast_equal_oracle(spark, name):
    """The plans of inputs too large to broadcast, with groups cut into many ranges."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "13",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        compare(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="no test tables")
def test_entry_gives_the_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "link_id", "speed", "volume", "hist_link_id", "avg_speed", "avg_volume", "ts",
    ]
