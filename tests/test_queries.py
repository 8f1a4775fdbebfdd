"""Every query against its SQL on the provided tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from windrow.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, name, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["qc_flags", "qc_sustained_low", "qc_curtail_derate", "qc_environment",
                                  "impute_anemometer", "gap_fill_linear", "gap_fill_circular", "time_spine",
                                  "sampling_interval", "gap_fill_tiered"])
def test_block_edges(spark, con, small_blocks, name):
    """Results do not depend on where the blocks end."""
    assert compare(spark, con, name, QUERIES[name], SQL[name], SF) is None


def test_partition_count(spark, con):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        for name in ("qc_flags", "wake_free_stream", "yaw_fit", "multi_file_union"):
            assert compare(spark, con, name, QUERIES[name], SQL[name], SF) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
