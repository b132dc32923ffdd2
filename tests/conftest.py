import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from spotframe.session import local_session

    return local_session(4, "4g", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
