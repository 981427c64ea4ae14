from __future__ import annotations

import pytest

from weirflow.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as sorted tuples, in the order of the named columns."""

    def of(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return of
