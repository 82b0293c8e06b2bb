from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from boxoffice.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """table(schema, *rows): a small DataFrame."""

    def make(schema: str, *rows: tuple):
        return spark.createDataFrame(list(rows), schema)

    return make


def rows(df, *names: str) -> set:
    picked = df.select(*names) if names else df
    return {tuple(r) for r in picked.collect()}
