"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_matches_oracle(spark, con, name):
    outcome = compare(spark, con, name, SF)
    assert outcome.startswith(("ok", "rows")), outcome


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["page_id", "part", "n_items", "n_vertical", "payload"]
    assert df.count() > 0
