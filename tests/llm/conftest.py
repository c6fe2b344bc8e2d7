import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_edges import EDGES, make_docs  # noqa: E402


@pytest.fixture
def edges(spark):
    return make_docs(spark, EDGES)


@pytest.fixture
def nothing(spark):
    return make_docs(spark, [])
