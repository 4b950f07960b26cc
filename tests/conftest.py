import datetime as dt
import os
import sys
from zoneinfo import ZoneInfo

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NY = ZoneInfo("America/New_York")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tickerloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "Asia/Tokyo")  # results must not depend on it
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def et(date, hms):
    """Epoch second of a New York date and wall time."""
    y, m, d = map(int, date.split("-"))
    h, mi, s = map(int, hms.split(":"))
    return int(dt.datetime(y, m, d, h, mi, s, tzinfo=NY).timestamp())


class Tape:
    """Builds a small trade/quote tape row by row; arrival is the order of the calls."""

    schema = (
        "symbol string, kind string, price double, size double, sip_ns bigint, seq bigint,"
        " conditions array<int>, arrival bigint, session_date date"
    )

    def __init__(self):
        self.rows = []

    def trade(self, symbol, sec, price, size, conditions=(), ns=0):
        n = len(self.rows)
        day = dt.datetime.fromtimestamp(sec, NY).date()
        self.rows.append(
            (symbol, "trade", float(price), float(size), sec * 10**9 + ns, n, list(conditions), n, day)
        )
        return self

    def quote(self, symbol, sec):
        n = len(self.rows)
        day = dt.datetime.fromtimestamp(sec, NY).date()
        self.rows.append((symbol, "quote", None, None, sec * 10**9, n, [], n, day))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, self.schema)


@pytest.fixture
def tape():
    return Tape()
