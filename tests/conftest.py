import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from strophe.session import build

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = build(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false", spark__local__dir=scratch,
        spark__sql__warehouse__dir=f"{scratch}/warehouse", spark__checkpoint__dir=f"{scratch}/shared", spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
