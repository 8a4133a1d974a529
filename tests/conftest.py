import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stockspark.session import get_session
    ckpt = tempfile.mkdtemp(prefix="stockspark-test-ckpt-")
    s = get_session("local[4]", 4, extra={"spark.checkpoint.dir": ckpt,
                                          "spark.driver.memory": "4g"})
    yield s


@pytest.fixture(scope="session")
def views(spark):
    from stockspark.sources.views import Views
    return Views(spark, SF001)
