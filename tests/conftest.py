import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_spark, ship

    s = get_spark("tests", cores=4, shuffle_partitions=4)
    ship(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test data here")
    return at
