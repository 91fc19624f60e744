import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from annalist.session import local_session

    return local_session(app="tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate one column expression on one text."""

    def evaluate(expression, text=""):
        return spark.createDataFrame([(text,)], "text string").select(expression.alias("v")).first()["v"]

    return evaluate
