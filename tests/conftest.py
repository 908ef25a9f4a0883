import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skeinflow.session import get_session

    s = get_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
