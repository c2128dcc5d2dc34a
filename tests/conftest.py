import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from acqlens.session import get_session

    s = get_session("local[4]", app_name="acqlens-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def players_small(spark):
    from acqlens.sources import fixtures

    return fixtures.players(spark, SF_SMALL).cache()
