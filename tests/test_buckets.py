"""The bucketed daily table: same rows as the plain edits, and no shuffle of daily rows."""

import re
import uuid

import pytest
from conftest import make_daily, random_series
from dayplan.operators.edits import fold_edits, set_forecast, write_fields
from dayplan.schema import EDITABLE
from dayplan.sources.buckets import BucketedTable
from pyspark.sql import functions as F

KEYS = ["series_key"]


@pytest.fixture
def table(spark, tmp_path):
    made = BucketedTable(spark, f"daily_{uuid.uuid4().hex[:8]}", f"file://{tmp_path}", KEYS, buckets=6)
    made.create(make_daily(spark, random_series(), keyed=True))
    yield made
    made.drop()


def edit_lists(daily, n):
    """Two lists that share days, with repeated and unknown days."""
    day = F.dayofyear("date")
    rows = daily.select("series_key", "date", (day * 7).cast("bigint").alias("value"), (day % 5).cast("bigint").alias("seq"))
    again = rows.withColumn("value", F.col("value") + 1).withColumn("seq", F.col("seq") + 1)
    stray = rows.limit(3).withColumn("series_key", F.lit("nobody"))
    return [rows.unionByName(again).unionByName(stray).filter(day % (k + 2) == 0).withColumn("value", F.col("value") + k) for k in range(n)]


def content(df):
    return sorted(map(tuple, df.select("series_key", "date", "demand", "production_plan", "forecast", "inventory").collect()), key=str)


def scans_below_an_exchange(df):
    """Table scans of the plan that stand below an exchange, by depth."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above, found = [], []
    for line in text.splitlines():
        body = re.sub(r"^[\s:+|-]*", "", line)
        depth = len(line) - len(body)
        above = [(d, name) for d, name in above if d < depth] + [(depth, body)]
        if "FileScan parquet spark_catalog" in body:
            found.append(any(re.sub(r"^\*\(\d+\) ", "", name).startswith("Exchange") for _, name in above))
    return found


def test_two_lists_give_the_rows_of_plain_edits_without_a_shuffle_of_the_table(spark, table):
    plain = make_daily(spark, random_series(), keyed=True)
    for changes in edit_lists(plain, 2):
        planned = table.edited(changes.withColumn("field", F.lit("forecast")))
        assert scans_below_an_exchange(planned) == [False]
        plain = set_forecast(plain, changes, KEYS)
        table.set_forecast(changes)
        assert content(table.read()) == content(plain)
        files = table.read().inputFiles()
        assert len(files) == 6  # one file for each bucket, also after an edit


def test_all_fields_and_empty_lists(spark, table):
    daily = make_daily(spark, random_series(), keyed=True)
    changes = edit_lists(daily, 1)[0].withColumn("field", F.element_at(F.array(*map(F.lit, EDITABLE)), (F.col("seq") % 3 + 1).cast("int")))
    want = content(write_fields(daily, fold_edits(changes, KEYS), KEYS))
    table.update(changes.limit(0), EDITABLE)
    assert content(table.read()) == content(daily)
    table.update(changes, EDITABLE)
    assert content(table.read()) == want != content(daily)


def test_a_failed_edit_leaves_the_table(spark, table):
    before = content(table.read())
    broken = edit_lists(table.read(), 1)[0].withColumn("value", F.raise_error(F.lit("no number")).cast("bigint"))
    with pytest.raises(Exception, match="no number"):
        table.set_forecast(broken)
    assert content(table.read()) == before
