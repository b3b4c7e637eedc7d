import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spotframe.session import build_session
    s = build_session("local[2]", 4, app="spotframe-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sf-test-ckpt-")})
    yield s
    s.stop()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
