import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    # Tiny inputs: compiling generated code would take most of the time.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()
