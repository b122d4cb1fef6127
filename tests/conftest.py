import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casegrid.session import local_session  # noqa: E402


# Started on import: test modules build column expressions at module level.
SESSION = local_session(4, "6g", "casegrid-tests")
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of inputs in column ``v``."""

    def run(inputs, dtype, expression):
        rows = [(i, value) for i, value in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, v {dtype}")
        return [row[0] for row in df.select("i", expression.alias("r")).orderBy("i").select("r").collect()]

    return run
