import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from excerpta.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("excerpta-tests", cores=4, shuffle_partitions=2, memory="4g")
    # Tiny inputs: interpreted plans start faster than compiled ones.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
