"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from catalog import QUERIES
from check import compare, oracle

SMOKE = entry_module.SMOKE_DIR
SLOW = {"boosted_windows", "window_tuning", "monitor_stream", "monitor_whole"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle(SMOKE)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    note, _, _ = compare(spark, con, SMOKE, name, entry_module.queries()[name], entry_module.oracle_sql().get(name))
    assert note.startswith(("ok", "rows")), note


def test_every_check_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
