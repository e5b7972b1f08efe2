import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from larder.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="larder-tests", shuffle_partitions=4)
    # Tests set their own checkpoint folder only where the session has none.
    checkpoint_dir(s, tempfile.mkdtemp(prefix="larder-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from larder.sources.seed import load_seed
    return load_seed(spark)


def rows(df, *cols):
    """Sorted list of tuples of the chosen columns."""
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
