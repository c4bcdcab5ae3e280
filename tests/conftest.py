import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tonegrid.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tonegrid-tests-")
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__session__timeZone="UTC",
        spark__checkpoint__dir=folder,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """The hand-worked corpus: pos totals 5, neg totals 5."""
    rows = [
        (0, "pos", ["good", "good", "day"]),
        (1, "pos", []),
        (2, "pos", ["good", "film"]),
        (3, "neg", ["bad", "day"]),
        (4, "neg", ["bad", "film", "bad"]),
    ]
    return spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>").persist()
