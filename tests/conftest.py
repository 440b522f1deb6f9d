import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewash.session import get_spark  # noqa: E402

# The company table.
COMPANIES = [
    ("C-Corp", 1, "08/08/1997"), ("Apple", 22, "01/04/1976"), ("Microsoft", 8, "04/04/1975"),
    ("Nokia", 18, "12/05/1865"), ("Samsung", 7, "01/03/1938"), ("Huawei", 10, "15/09/1987"),
    ("Razer", 3, "01/01/1998"), ("Imagine Breakers", 14, "21/09/1996"), ("Sony", 9, "07/05/1946"),
    ("Asus", 12, "02/04/1989"), ("Hewlett-Packard", 5, "01/01/1939"), ("Toshiba", 8, "01/07/1975"),
    ("LG Electronics", -3, "01/10/1958"), ("Nintendo", 21, "23/09/1989"), ("Elevate ltd", 41, "08/08/1997"),
    ("Dummy", -17, "01/07/1975"),
]

# The viewer tables.
VIEWER = [
    ("C-Corp", 1, "08/08/1997"), ("Apple", 10, "01/04/1976"), ("Microsoft", 8, "04/04/1975"),
    ("Nokia", 3000, "12/05/1865"), ("Samsung", 7, "01/03/1938"), ("Huawei", 4521, "15/09/1987"),
    ("Razer", 9000, "01/01/1998"),
]
STATISTICS = [
    ("haha", 1, "01/01/2001"), ("hihi", 2, "01/01/2001"), ("hoho", 3, "01/01/2001"), ("haha", 2, "20/05/2013"),
    (None, 2, None), (None, 4, "05/12/2017"),
]


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", master="local[*]", shuffle_partitions=8,
                        **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def companies(spark):
    return spark.createDataFrame(
        [(name, number, date, None, None, None, None) for name, number, date in COMPANIES],
        "string string, number int, date_string string, garbage string, fpoint double, raw_time string, "
        "date_time timestamp_ntz")


@pytest.fixture(scope="session")
def viewer(spark):
    return spark.createDataFrame(VIEWER * 10, "string string, number int, date_time string")


@pytest.fixture(scope="session")
def statistics(spark):
    return spark.createDataFrame(STATISTICS, "string string, number int, date_time string")
