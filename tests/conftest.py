from __future__ import annotations

import pytest

from verification.compare import session


@pytest.fixture(scope="session")
def spark():
    return session("4", memory="6g")


@pytest.fixture
def rows(spark):
    """Rows of a frame as plain tuples, in the order of a sort on all of them."""

    def read(df, *columns):
        found = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in found.collect()), key=str)

    return read
