import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from moodline.session import build_session
    s = build_session("local[4]", app="moodline-tests", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, *cols):
    """Values of ``cols`` (all columns if none) as a list of tuples."""
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
