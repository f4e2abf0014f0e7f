from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skeinwork.session import session

    root = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", **{"spark__driver__memory": "3g", "spark__ui__enabled": "false", "spark__sql__shuffle__partitions": "4", "spark__ui__showConsoleProgress": "false",
                       "spark__sql__warehouse__dir": str(root / "warehouse"), "spark__checkpoint__dir": f"file://{root}/checkpoint"},
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small():
    return SMALL
