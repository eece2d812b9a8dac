import datetime as dt

import pytest
from conftest import values
from dayplan.functions.dates import normalize_date
from dayplan.functions.numbers import half_even, stable_uuid, stored_whole
from dayplan.operators.migrate import migrate_date_format, normalize_date_column
from pyspark.sql import functions as F


def parse(spark, texts, as_of=None):
    frame = spark.createDataFrame([(text,) for text in texts], "raw string")
    out = frame.select(normalize_date(F.col("raw"), as_of).alias("d")).collect()
    return [None if row["d"] is None else row["d"].isoformat() for row in out]


def test_accepted_forms(spark):
    texts = ["July 2024", "july 2024", "March 2025", "05-01-2024", "05/01/2024", "2024-01-05", " 2024-1-5 "]
    expected = ["2024-07-01", "2024-07-01", "2025-03-01"] + ["2024-01-05"] * 4
    assert parse(spark, texts) == expected


def test_rejected_forms(spark):
    texts = ["31-02-2024", "junk", "", None, "July", "today", "2024-13-01", "2024-01-05 x", "May2024"]
    assert parse(spark, texts) == [None] * len(texts)


def test_forms_relative_to_a_day(spark):
    texts = ["July", "today", "Yesterday", "tomorrow", "JULY", "jul", "Jul  2023", "junk", "5 march 2024"]
    expected = ["2024-07-01", "2024-06-15", "2024-06-14", "2024-06-16"]
    expected += ["2024-07-01", "2024-07-01", "2023-07-01", None, "2024-03-05"]
    assert parse(spark, texts, "2024-06-15") == expected
    assert parse(spark, ["May"], dt.date(2020, 2, 2)) == ["2020-05-01"]


def test_days_as_people_write_them(spark):
    fifth = [
        "January 5, 2024", "january 5th 2024", "5 January 2024", "5th of January, 2024", "Jan 5 2024", "5 jan 2024",
        "05.01.2024", "5.1.2024", "2024/01/05", "2024.1.5", "2024-01-05 10:00:00", "2024-01-05T10:00:00.250Z",
        "2024-01-05 10:00 pm", "05/01/2024 23:59", "5 de enero de 2024", "el 5 de Enero del 2024", "5 ene 2024",
        "Friday, January 5, 2024", "viernes 5 de enero de 2024", "2024 January 5", "5-1-2024", "\t05-01-2024 ",
    ]
    assert parse(spark, fifth) == ["2024-01-05"] * len(fifth)
    others = {
        "April 1st 2024": "2024-04-01", "12/25/2024": "2024-12-25", "diciembre 2023": "2023-12-01", "Sept 2024": "2024-09-01",
        "29 February 2024": "2024-02-29", "29 February 2023": None, "13/13/2024": None, "32 January 2024": None, "5 foo 2024": None,
        "January 5 6 2024": None, "5 January 6": None, "January 20245": None, "1 2 3": None, "05-01-24": None, "10:00": None, "5": None,
        "January February 2024": None, "in 3 days": None, "5 January": None,
    }
    assert parse(spark, list(others)) == list(others.values())


def test_offsets_and_words_in_two_languages(spark):
    relative = {
        "in 3 days": "2024-02-03", "in 1 day": "2024-02-01", "2 weeks ago": "2024-01-17", "in 1 month": "2024-02-29",
        "1 year ago": "2023-01-31", "3 days ago": "2024-01-28", "hace 2 semanas": "2024-01-17", "en 3 días": "2024-02-03",
        "dentro de 2 meses": "2024-03-31", "hace 1 año": "2023-01-31", "hoy": "2024-01-31", "Ayer": "2024-01-30",
        "MAÑANA": "2024-02-01", "5 January": "2024-01-05", "5 de mayo": "2024-05-05", "mayo": "2024-05-01",
        "in days": None, "in 3 apples": None, "3 days": None, "in 99999 days": None,
    }
    assert parse(spark, list(relative), "2024-01-31") == list(relative.values())


def test_column_form(spark):
    frame = spark.createDataFrame([(1, "1/2/2024")], "n int, raw string")
    assert normalize_date_column(frame, "raw").first()["date"] == dt.date(2024, 2, 1)


def test_text_of_a_filter_becomes_a_literal_for_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2024, 1, i), i) for i in range(1, 5)], "date date, v int")
    rows.write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(
        F.col("date") == normalize_date(F.lit("3/1/2024"))
    )
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(date,2024-01-03)" in text
    assert values(plan, "v") == [3]


def test_migration_of_stored_text(spark):
    stored = [
        "05-01-2024",  # becomes ISO
        "2024-01-06",
        "06-01-2024",  # would hit the row above
        "2024-1-7",  # kept, and not the same text as the next target
        "07-01-2024",
        "8-1-2024",  # loses against the padded form
        "08-01-2024",
        "31-02-2024",
        "not-a-date",
    ]
    frame = spark.createDataFrame(list(zip(stored, range(9))), "date_text string, demand int")
    out = {row["demand"]: row["date_text"] for row in migrate_date_format(frame).collect()}
    assert out == {
        0: "2024-01-05",
        1: "2024-01-06",
        2: "06-01-2024",
        3: "2024-1-7",
        4: "2024-01-07",
        5: "8-1-2024",
        6: "2024-01-08",
        7: "31-02-2024",
        8: "not-a-date",
    }


@pytest.mark.parametrize(
    "value, rounded, whole",
    [(0.125, 0.12, 0), (0.375, 0.38, 0), (109.999, 110.0, 110), (-3.7, -3.7, -3), (12.99, 12.99, 12)],
)
def test_rounding(spark, value, rounded, whole):
    row = spark.range(1).select(half_even(F.lit(value)), stored_whole(F.lit(value))).first()
    assert tuple(row) == (rounded, whole)


def test_ids_have_the_shape_of_a_uuid(spark):
    row = spark.range(1).select(stable_uuid(F.lit("7")), stable_uuid(F.lit(7))).first()
    assert row[0] == row[1] == "8f14e45f-ceea-167a-5a36-dedd4bea2543"
