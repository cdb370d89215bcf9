"""Every registered query against its SQL, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# These need more threads or clusters than the smallest data set has.
MAY_BE_EMPTY = {"topic_network_edges", "noise_thread_summary"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result is None or (name in MAY_BE_EMPTY and result == "no rows on either side")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
