import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyfield.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def one(spark):
    """Value of a column expression on a single row."""

    def value(*cols):
        row = spark.range(1).select(*cols).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return value
