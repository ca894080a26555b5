import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def shared(spark):
    from siftwell.llm.common import Shared

    return Shared(spark)


@pytest.fixture
def edges(spark):
    import edge

    return edge.table(spark)
