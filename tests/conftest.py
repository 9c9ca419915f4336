import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from combirisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def edges(spark):
    """Triangle a-b-c, tail c-d-e."""
    rows = [
        ("a", "b", 4, "Contraindicated interaction", 10.0),
        ("a", "c", 3, "Major interaction", 7.0),
        ("b", "c", 2, "Moderate interaction", 4.0),
        ("c", "d", 1, "Minor interaction", 1.0),
        ("d", "e", 3, "Major interaction", 7.0),
    ]
    return spark.createDataFrame(rows, "a string, b string, numeric int, label string, weight double")
