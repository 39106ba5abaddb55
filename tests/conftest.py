import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session

    session = local_session(4, "3g", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
