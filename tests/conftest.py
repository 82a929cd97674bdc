import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(at / "warehouse"), "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
