import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wayfold.session import local_session

    s = local_session("tests", cores=4, partitions=4, memory="4g")
    s.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield s
    s.stop()


def rows(df):
    """Rows as sorted tuples in the order of the columns."""
    order = lambda r: tuple((0, x, "") if isinstance(x, (int, float)) else (1, 0, str(x)) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=order)
