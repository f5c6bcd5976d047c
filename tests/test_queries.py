"""Every query outside the optional subpackages against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import importlib.util
import os

import pytest

from tesserae import catalogue

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def compare():
    spec = importlib.util.spec_from_file_location("compare", f"{ROOT}/tools/compare.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def duck(compare):
    return compare.oracle(SF)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, compare, duck, name):
    assert compare.compare(spark, duck, SF, name) == ""


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
