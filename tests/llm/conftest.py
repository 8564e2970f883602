import pytest

from choicekit.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
