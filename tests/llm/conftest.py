import pytest

from tracelake.llm.common import reach_workers


@pytest.fixture(autouse=True)
def reachable(spark):
    reach_workers(spark)
