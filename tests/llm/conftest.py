import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def llm(spark):
    from lodestone.llm.runtime import prepare

    prepare(spark)
    return spark


@pytest.fixture()
def rng():
    return random.Random(7)

