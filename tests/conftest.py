import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kgenrich.session import checkpoint_dir, get_spark

    s = get_spark("tests", cpus=4, shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


def one(spark, col, value, schema="v string"):
    """Evaluate a Column expression on a one-row frame with column ``v``."""
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r
