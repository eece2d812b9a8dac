import datetime as dt
import random

import pytest
from conftest import by_series, day, make_daily, values
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv

KEYS = ["series_key"]
EDIT = "series_key string, date date, field string, value bigint, seq bigint"


def stock(df):
    return values(df.orderBy("date"), "inventory")


def test_one_demand_edit(spark, daily_13):
    change = ed.one_edit(spark, "05-01-2024", "demand", 300)
    edited = ed.set_demand(daily_13, change)
    assert stock(edited) == [10] * 4 + list(range(-175, -94, 10))
    assert inv.stockouts(edited).count() == 9
    asked = inv.stockout_proposals(edited).collect()
    assert all(row["proposed_production_plan"] == row["demand"] for row in asked)
    assert all(row["resulting_inventory"] == 0 for row in asked)


def test_one_plan_edit(spark, daily_13):
    change = ed.one_edit(spark, "2024-01-12", "production_plan", 0)
    assert stock(ed.set_production_plan(daily_13, change)) == [10] * 11 + [-102, -92]


def test_an_edit_of_a_missing_day_changes_nothing(spark, daily_13):
    change = ed.one_edit(spark, "2023-01-05", "demand", 300)
    assert stock(ed.set_demand(daily_13, change)) == [10] * 13
    row = ed.edit_report(daily_13, change).first()
    assert (row["outcome"], row["message"]) == ("not_found", "No record found for date 2023-01-05.")
    there = ed.edit_report(daily_13, ed.one_edit(spark, "2024-01-05", "demand", 1)).first()
    assert (there["outcome"], there["message"]) == ("updated", None)


def test_an_edit_without_a_value_fails(spark, daily_13):
    change = spark.createDataFrame([(day("2024-01-05"), None)], "date date, value bigint")
    with pytest.raises(Exception, match="edit value is NULL"):
        ed.set_demand(daily_13, change).collect()


def one_by_one(rows, edits):
    """Apply edits singly in order, each followed by its own recalculation."""
    series = {name: [list(row) for row in held] for name, held in by_series(rows).items()}
    place = {"demand": 2, "production_plan": 3, "forecast": 4}
    for name, date, field, value, _ in sorted(edits, key=lambda edit: edit[4]):
        held = series.get(name, [])
        at = next((i for i, row in enumerate(held) if row[1] == date), None)
        if at is None:
            continue
        held[at][place[field]] = value
        if field != "forecast":
            balance = held[at - 1][5] if at else 0
            for row in held[at:]:
                balance += row[3] - row[2]
                row[5] = balance
    return sorted((tuple(row) for held in series.values() for row in held), key=str)


@pytest.mark.parametrize("count", [1, 40, 400])
def test_edits_equal_single_updates_in_order(spark, many, count):
    rows, daily = many
    pick = random.Random(count)
    edits = []
    for seq in range(count):
        row = pick.choice(rows)
        date = row[1] if pick.random() < 0.9 else row[1] + dt.timedelta(days=1)
        field = pick.choice(["demand", "production_plan", "forecast"])
        edits.append((row[0], date, field, pick.randrange(300), seq))
    got = ed.apply_edits(daily, spark.createDataFrame(edits, EDIT), KEYS)
    assert sorted(map(tuple, got.collect()), key=str) == one_by_one(rows, edits)


def test_many_starting_days_give_the_same_rows(spark, many):
    rows, daily = many
    edits = [(row[0], row[1], "demand", 7, seq) for seq, row in enumerate(sorted(rows)[300:420])]
    edits.append(("s6", max(rows)[1], "forecast", 3, 500))
    frame = spark.createDataFrame(edits, EDIT)
    got = ed.apply_edits(daily, frame, KEYS)
    assert sorted(map(tuple, got.collect()), key=str) == one_by_one(rows, edits)


def test_upsert_takes_the_last_change_of_a_day_or_fails(spark, daily_13):
    day = dt.date(2024, 1, 5)
    changes = spark.createDataFrame(
        [(day, 1, 1, 0, 1), (day, 100, 120, 0, 2)], "date date, demand bigint, production_plan bigint, forecast bigint, seq int"
    )
    rows = {row.date: row for row in ed.upsert_daily(daily_13, changes).collect()}
    assert len(rows) == daily_13.count() and rows[day].demand == 100
    with pytest.raises(Exception, match="several changes for one day"):
        ed.upsert_daily(daily_13, changes.drop("seq")).collect()


def test_edits_without_keys(spark, many):
    rows = [row for row in many[0] if row[0] == "s5"]
    edits = [(row[0], row[1], "demand", 7, seq) for seq, row in enumerate(sorted(rows)[50:60])]
    frame = spark.createDataFrame(edits, EDIT).drop("series_key")
    got = ed.apply_edits(make_daily(spark, [row[1:] for row in rows]), frame)
    expected = [row[1:] for row in one_by_one(rows, edits)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_shift(daily_13):
    assert stock(ed.shift_demand(daily_13, 50)) == [-40 * i for i in range(1, 14)]
    assert stock(ed.shift_demand(daily_13, 0)) == [10] * 13


def test_forecast_edits_do_not_move_the_stock(spark, daily_13):
    changes = spark.createDataFrame(
        [(day("2024-01-11"), 10), (day("2024-01-12"), 20), (day("2024-01-13"), 30)],
        "date date, value bigint",
    )
    edited = ed.set_forecast(daily_13, changes)
    assert stock(edited) == [10] * 13
    cleared = ed.clear_forecast_range(edited, "2024-01-12", "2024-01-13").orderBy("date")
    assert values(cleared, "forecast")[-3:] == [10, None, None]
    open_end = ed.clear_forecast_range(edited, "2024-01-12").orderBy("date")
    assert values(open_end, "forecast")[-3:] == [10, None, None]
    assert set(values(ed.clear_all_forecast(edited), "forecast")) == {None}


def test_outcome_of_clearing(daily_13):
    none = ed.clear_forecast_outcome(daily_13, "2025-01-01", "2025-01-05").first()
    assert none["message"] == "No forecast values found in the specified date range."
    some = ed.clear_forecast_outcome(daily_13, "12-01-2024", "2024-01-13").first()
    assert (some["cleared"], some["message"]) == (
        2,
        "Forecast cleared from 2024-01-12 to 2024-01-13.",
    )
    tail = ed.clear_forecast_outcome(daily_13, "2024-01-12").first()
    assert tail["message"] == "Forecast cleared on or after 2024-01-12."
    assert set(values(ed.clear_forecast_range(daily_13, "2025-01-01"), "forecast")) == {0}


CHANGE = "date date, demand bigint, production_plan bigint, forecast bigint"


def test_upsert_renumbers_the_tail(spark, daily_13):
    rows = [(day("2024-01-12"), 1, 2, 3), (day("2024-01-13"), 1, 2, 3), (day("2024-01-14"), 4, 5, 6)]
    out = ed.upsert_daily(daily_13, spark.createDataFrame(rows, CHANGE)).orderBy("date")
    assert out.count() == 14
    assert values(out, "inventory")[-3:] == [11, 12, 13]
    assert values(out, "forecast")[-3:] == [3, 3, 6]


def test_upsert_in_the_middle(spark, daily_13):
    change = spark.createDataFrame([(day("2024-01-05"), 0, 100, 3)], CHANGE)
    full = ed.upsert_daily(daily_13, change)
    assert stock(full) == [10] * 4 + [110 + 10 * i for i in range(9)]
    only = ed.upsert_daily(daily_13, change, recalc_tail=False)
    assert stock(only) == [10] * 4 + [110] + [10] * 8


def test_upsert_without_forecast_keeps_it(spark, daily_13):
    rows = [(day("2024-01-13"), 1, 2), (day("2024-01-14"), 4, 5)]
    change = spark.createDataFrame(rows, "date date, demand bigint, production_plan bigint")
    out = ed.upsert_daily(daily_13, change).orderBy("date")
    assert values(out, "forecast")[-2:] == [0, None]


def test_upsert_into_an_empty_table(spark, daily_13):
    change = spark.createDataFrame([(day("2024-01-05"), 2, 10, 3)], CHANGE)
    assert stock(ed.upsert_daily(daily_13.filter("false"), change)) == [8]


def test_calendar_extension(spark, daily_13, many):
    ahead = ed.extend_calendar(daily_13, 3).orderBy("date")
    assert values(ahead, "date") == [day("2024-01-14"), day("2024-01-15"), day("2024-01-16")]
    assert ed.extend_calendar(daily_13, 0).count() == 0
    assert ed.extend_calendar(many[1], 5, "2030-01-01", KEYS).count() == 7 * 5


def test_delete_all(daily_13):
    empty, report = ed.delete_all_daily(daily_13)
    assert empty.count() == 0 and empty.schema == daily_13.schema
    assert tuple(report.first()) == (13, 0)


def test_ensure_column(daily_13):
    bare = daily_13.drop("forecast")
    assert set(values(ed.ensure_column(bare, "forecast", "bigint", 0), "forecast")) == {0}
    assert ed.ensure_column(daily_13, "forecast", "bigint", 9) is daily_13


def test_forecasts_are_stored_as_whole_numbers(spark, daily_13):
    rows = [(day("2024-01-13"), 12.99), (day("2024-01-14"), -3.7), (day("2024-01-15"), None)]
    made = spark.createDataFrame(rows, "date date, forecast double")
    kept = fc.persist_forecast(daily_13, made).orderBy("date")
    assert kept.count() == 13 and values(kept, "forecast")[-1] == 12
    added = fc.persist_forecast(daily_13, made, mode="upsert").orderBy("date")
    assert [tuple(row) for row in added.collect()][-1] == (day("2024-01-14"), None, None, -3, None)
    assert added.count() == 14
