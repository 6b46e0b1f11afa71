import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from kiln.session import build_session

    s = build_session("local[4]", app_name="kiln-tests", shuffle_partitions=8)
    yield s
    s.stop()


def one_col(spark, values, name="c", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
