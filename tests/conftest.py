import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dayspan.session import local_session
    s = local_session("*", shuffle_partitions=8, driver_memory="8g")
    yield s


def _null_last(t):
    return tuple((1, 0) if v is None else (0, v) for v in t)


def rows(df, *cols):
    """Rows as sorted tuples (nulls sort last within a column)."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=_null_last)
