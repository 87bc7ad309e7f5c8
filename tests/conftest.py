import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pitchgrid.session import local_session

    session = local_session(4, 4)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield session
    session.stop()


DATA = Path("/root/testdata/sf0.01")


@pytest.fixture
def data():
    if not DATA.exists():
        pytest.skip("the given tables are not here")
    return str(DATA)
