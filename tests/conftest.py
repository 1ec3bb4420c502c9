import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from matchlake.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", 4, shuffle_partitions=4)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
