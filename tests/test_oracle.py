"""Every query against its DuckDB statement, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from corpusloom.plans.recipes import QUERIES
from verification.check import compare, connect
from verification.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"src_manifest", "schema_listing"}


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, *_ = compare(spark, duck, SF_DIR, name)
    assert verdict.startswith("rows only" if name in ROWS_ONLY else "ok"), verdict


def test_contract(spark):
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert contract.entry(spark).columns == ["query_id", "part", "item", "score", "rank"]
