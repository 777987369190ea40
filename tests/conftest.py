import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from motorlake.session import session, ship

    spark = session("local[4]", shuffle_partitions=4, memory="4g", app="tests")
    ship(spark)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
