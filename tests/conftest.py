import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stormweave.session import local_session

    session = local_session(8, 8, spark__sql__ui__retainedExecutions="5")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    """A new folder below the session's shared folder."""
    import uuid

    from stormweave.session import shared_folder

    return f"{shared_folder(spark)}/tests/{uuid.uuid4().hex}"
