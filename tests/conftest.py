import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mullion.session import local_session

    s = local_session(8, 8, "6g")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch(spark):
    from mullion.scale import Scratch

    return Scratch(spark)
