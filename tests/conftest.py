from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rulemark.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session("local[4]", partitions=4, spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__warehouse__dir=str(where / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
