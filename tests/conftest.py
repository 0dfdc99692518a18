import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from thicket.session import local_session, ship

    s = local_session("tests", cores="4", partitions=4)
    ship(s)
    yield s
    s.stop()
