"""Every registered core query against its SQL; the ones without SQL must run and have a stable schema."""

import importlib

import pytest

from tests.oracle import compare

PLANS = ["hierarchy", "search", "memory", "graph", "mapping", "corpus", "mutation", "reports", "stream", "recall", "review", "details"]
MODULES = [importlib.import_module(f"skerry.plans.{p}") for p in PLANS]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, name):
    compare(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
