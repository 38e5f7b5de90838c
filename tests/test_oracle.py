"""Every registered query against its SQL on the smallest tables."""

import pytest

from check import compare, connect, entry

SF = "/root/testdata/sf0.001"
# minutes each; ``tests/check.py`` runs them
SLOW = {"rf_fit", "svm_probability", "grid_search", "forest_search", "model_saved"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.LIBRARY - SLOW))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_sql():
    assert entry.LIBRARY <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r["share"] for r in rows) - 1) < 1e-5
