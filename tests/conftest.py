import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = "/root/testdata/sf0.001"
SMALL = {
    "clv": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3},
    "churn": {"numTrees": 20, "maxDepth": 6},
    "segments": {"restarts": 3, "maxIter": 50},
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from patronlens.session import local_session
    from patronlens.staging import drop_staged

    session = local_session(str(tmp_path_factory.mktemp("staged")), 8)
    yield session
    drop_staged(session)


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def customers(spark, folder):
    from checks.frames import staged_profile

    return staged_profile(spark, folder)


@pytest.fixture(scope="session")
def training(spark, folder):
    """A run with small models; the registered queries train the full ones."""
    from checks.frames import profile
    from patronlens.plans.training import train

    return train(profile(spark, folder), **SMALL)
