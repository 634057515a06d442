"""Every registered query against its SQL twin on DuckDB."""

from pathlib import Path

import pytest

from cellframe.registry import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    from check_queries import connect

    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    from check_queries import compare

    q = REGISTRY[name]
    text, ok = compare(q.run(spark, SF), con, q.sql)
    assert ok, text


def test_names_are_unique_and_sql_is_plain():
    assert len(REGISTRY) > 100
    with_sql = [q for q in REGISTRY.values() if q.sql]
    assert len(with_sql) > 100
