import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from carelens.session import get_session
    s = get_session("local[4]", app_name="carelens-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.harness import duck
    return duck(SF_SMALL)


@pytest.fixture()
def tables(spark):
    """An empty CareTables whose tables a test fills with mini DataFrames."""
    from carelens.sources.adapters import CareTables

    def make(**frames):
        t = CareTables(spark, "/nonexistent")
        t.put(**frames)
        return t
    return make
