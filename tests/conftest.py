import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fabtrail.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
TS = "2024-06-01T00:00:00"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fabtrail-tests",
        master="local[8]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write files below a folder of the test; returns the folder."""

    def put(**files):
        for name, content in files.items():
            name = name.replace("__", ".")
            data = content if isinstance(content, bytes) else content.encode()
            (tmp_path / name).write_bytes(data)
        return str(tmp_path)

    return put
