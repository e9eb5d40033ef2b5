from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from candlewick import session

    shared = tmp_path_factory.mktemp("shared")
    s = session.local(
        4,
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=f"file://{tmp_path_factory.mktemp('warehouse')}",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return str(SF)
