import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rillstone.session import local_session

    s = local_session(cpus=4, partitions=3, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield s
    s.stop()
