import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from resona.session import local_session  # noqa: E402

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def base():
    return BASE


@pytest.fixture
def apply(spark):
    """Value of a column function on one text (or other value)."""
    from pyspark.sql import functions as F

    def run(function, value, kind="string"):
        row = spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x"))).first()
        return row[0]

    return run
