"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from check_queries import compare, connect
from tidemark.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    _, rows, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert note == "rows-only" or note.startswith("ok"), note
    assert "TYPES" not in note, note


def test_every_query_is_registered_for_the_driver():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140
