import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from termdrift.session import session

    shared = tmp_path_factory.mktemp("shared")
    got = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=str(shared), spark__driver__memory="4g")
    got.sparkContext.setLogLevel("ERROR")
    yield got
    got.stop()
