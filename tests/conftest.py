import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from coursemine.session import local_session

    return local_session(cores=4, memory="4g")


@pytest.fixture
def one(spark):
    """Value of a column expression over one text ``x``."""
    def run(expression, x):
        return spark.createDataFrame([(x,)], "x string").select(expression(F.col("x")).alias("v")).first()["v"]

    return run
