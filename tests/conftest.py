import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from faultline.session import build_session

    import tempfile

    warehouse = tempfile.mkdtemp(prefix="faultline-warehouse-")
    s = build_session(master="local[*]", shuffle_partitions=8, app="faultline-tests",
                      extra={"spark.driver.memory": "8g", "spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()
