import pytest

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(autouse=True, scope="module")
def keeps_nothing(spark):
    """What the tests of a module cache is given up with it, so that later tests can see what the library keeps."""
    yield
    spark.catalog.clearCache()
