import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillon.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, 4, **{"spark.driver.memory": "3g", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
