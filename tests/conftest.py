import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from floeberg.session import local_session, ship_package

    folder = str(tmp_path_factory.mktemp("spark"))
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": folder})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    ship_package(s)
    yield s
    s.stop()
