import datetime as dt
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dayplan.schema import daily_schema  # noqa: E402
from dayplan.session import build_session  # noqa: E402
from dayplan.sources.staging import release  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

KEY = T.StructField("series_key", T.StringType(), False)
COLUMNS = ["date", "demand", "production_plan", "forecast", "inventory"]


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


def day(text):
    return dt.date.fromisoformat(text)


def make_daily(spark, rows, keyed=False):
    return spark.createDataFrame(rows, daily_schema([KEY] if keyed else []))


@pytest.fixture
def daily_13(spark):
    """Thirteen days whose stored inventory does not follow from the flows."""
    rows = [(dt.date(2024, 1, i), 100 + i, 110 + i, 0, 10) for i in range(1, 14)]
    return make_daily(spark, rows)


def random_series(seed=7, lengths=(1, 2, 9, 10, 11, 400, 900)):
    """Series of several lengths with gaps in the calendar; one holds most of the rows."""
    pick = random.Random(seed)
    rows = []
    for number, length in enumerate(lengths):
        date = dt.date(2019, 11, 3) + dt.timedelta(days=pick.randrange(200))
        for _ in range(length):
            date += dt.timedelta(days=pick.choice([1, 1, 1, 2, 30]))
            rows.append(
                (
                    f"s{number}",
                    date,
                    pick.randrange(-20, 200),
                    pick.randrange(0, 200),
                    pick.choice([None, pick.randrange(100)]),
                    pick.randrange(-500, 500),
                )
            )
    pick.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def many(spark):
    """The random series as Python rows and as a DataFrame."""
    rows = random_series()
    return rows, make_daily(spark, rows, keyed=True).cache()


def by_series(rows):
    series = {}
    for row in sorted(rows):
        series.setdefault(row[0], []).append(row)
    return series


def values(df, *columns):
    return [tuple(row) if len(columns) != 1 else row[0] for row in df.select(*columns).collect()]
