import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from larder.session import local_session

    session = local_session("8", partitions=8, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column over one row of named text columns."""
    from pyspark.sql import functions as F

    def value(make, *args):
        row = spark.range(1).select(*[F.lit(a).alias(f"a{i}") for i, a in enumerate(args)])
        return row.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return value
