import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import Settings, open_session

    work = tmp_path_factory.mktemp("spark")
    return open_session(Settings(master="local[8]", parallelism=4, conf={"spark.sql.warehouse.dir": str(work), "spark.driver.memory": "6g", "spark.driver.extraJavaOptions": f"-Dderby.system.home={work}"}))


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
