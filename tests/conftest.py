import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from helpers import days_from  # noqa: E402

from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                               "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """closes, [dates or start] -> (cid, date, close)"""

    def make(closes, start="2024-01-01", cid="a", dates=None):
        dates = dates or days_from(start, len(closes))
        rows = [(cid, d, float(c)) for d, c in zip(dates, closes) if c is not None]
        return spark.createDataFrame(rows, "cid string, date date, close double")

    return make

