"""Every core query over the smallest tables, against the SQL that states its result."""

import pytest

import __spark_entry__ as entry
import verify
from wayfold.plans.catalog import core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return verify.views(FOLDER)


@pytest.mark.parametrize("name", sorted(core.queries))
def test_query(spark, duck, name):
    got = core.queries[name](spark, FOLDER).toArrow()
    assert len(got.column_names) == len(set(got.column_names))
    if name in core.oracles:
        want = duck.execute(core.oracles[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert verify.rows_of(got) == verify.rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
