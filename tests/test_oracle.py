"""Every registered query against its DuckDB text on the smallest check tables."""

from pathlib import Path

import pytest

from boxoffice.plans.queries import QUERIES
from duckdb_texts.queries import ORACLE
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="check tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_text():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, SF) is None
