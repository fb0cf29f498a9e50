"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from configlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
