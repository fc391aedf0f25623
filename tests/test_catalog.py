"""Every catalogue query against its SQL twin, and streams against batches."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tenderlake import catalog

from .compare import oracle_connection, run_pair

ROOT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert run_pair(spark, con, ROOT, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() >= 0


def test_contract(spark):
    assert contract.entry(spark).columns == ["name", "close_bid_count", "meet_count", "lowest_price_close_count", "close_share_pct"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
