import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from coord.session import get_session

    s = get_session(
        "tests", "local[8]",
        **{
            "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g",
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("ckpt")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
