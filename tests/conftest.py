from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lateflow.session import checkpoint_root, get_session

    s = get_session("local[4]", app_name="lateflow-tests", shuffle_partitions=8)
    # Tests only: a local checkpoint folder when the session names none.
    checkpoint_root(s, fallback=tempfile.mkdtemp(prefix="lateflow-ckpt-"))
    yield s


def ts(s: str | None):
    return None if s is None else dt.datetime.fromisoformat(s)


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lateflow-test-")
