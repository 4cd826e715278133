"""Registered queries against their SQL texts. Those without one only run with ALL_QUERIES=1; their parts have tests of their own."""

import importlib.util
import os

import pytest

from tetrarank import workloads

FOLDER = "/root/testdata/sf0.001"
NAMES = list(workloads.all_queries()) if os.environ.get("ALL_QUERIES") else list(workloads.all_oracles())

spec = importlib.util.spec_from_file_location(
    "check_queries", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check_queries.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_every_sql_text_has_a_query():
    assert set(workloads.all_oracles()) <= set(workloads.all_queries())
    assert sum(len(m.QUERIES) for m in workloads.MODULES) == len(workloads.all_queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, n = check.compare(spark, con, name, FOLDER)
    assert problem is None and n > 0
