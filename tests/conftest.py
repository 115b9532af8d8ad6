import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakeworks.session import build_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="lakeworks-tests-")
    session = build_session("lakeworks-tests", "local[4]", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("driver tables are not here")
    return str(folder)


@pytest.fixture()
def folder(spark):
    from lakeworks.session import scratch_path

    return scratch_path(spark, "test")
