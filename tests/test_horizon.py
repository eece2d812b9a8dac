"""Stored projections beyond the history, planning with outcomes, and the nearest dates."""

import bisect
import datetime as dt
import random

import pytest
from conftest import COLUMNS, by_series, day, make_daily, values
from dayplan import Planner, StoredTable
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.operators import scans, summary
from dayplan.plans.forecast_to_plan import forecast_to_plan

KEYS = ["series_key"]


def ordered(df, *keys):
    return [tuple(row) for row in df.select(*keys, *COLUMNS).orderBy(*keys, "date").collect()]


@pytest.fixture
def projected_13(daily_13):
    """The thirteen days and three projected ones; the stored balance is that of the flows."""
    rows = inv.recalc_inventory(daily_13)
    return fc.persist_forecast(rows, fc.future_forecast_rows(rows, 3), mode="upsert")


def test_projections_leave_balance_history_and_latest_alone(daily_13, projected_13):
    rows = inv.recalc_inventory(daily_13)
    assert ordered(projected_13)[13:] == [(day(f"2024-01-{n}"), None, None, 112, None) for n in (14, 15, 16)]
    assert ordered(projected_13)[:13] == ordered(rows)
    for figure in (summary.latest_inventory, summary.kpi_cards, summary.history_bounds, summary.inventory_summary):
        assert figure(projected_13).collect() == figure(rows).collect()
    for make in (fc.future_forecast_rows, fc.moving_average_series, fc.demand_forecast_series, scans.demand_series):
        assert sorted(make(projected_13).collect()) == sorted(make(rows).collect())
    assert fc.moving_average_forecast(projected_13, 3, 1).collect() == fc.moving_average_forecast(rows, 3, 1).collect()
    assert values(ed.extend_calendar(projected_13, 1), "date") == [day("2024-01-14")]


def test_projections_survive_edits_and_recalculation(spark, projected_13):
    before = ordered(projected_13)
    assert ordered(inv.recalc_inventory(projected_13, "05-01-2024")) == before
    assert ordered(inv.recalc_inventory(projected_13, "15-01-2024", by_series=True)) == before
    shifted = ordered(ed.shift_demand(projected_13, 50))
    assert [row[4] for row in shifted] == [-40 * i for i in range(1, 14)] + [None] * 3
    edits = spark.createDataFrame(
        [("2024-01-05", "demand", 300, 1), ("2024-01-15", "demand", 9, 1), ("2024-01-15", "forecast", 8, 1), ("2024-01-16", "production_plan", 7, 1)],
        "date string, field string, value bigint, seq bigint",
    ).withColumn("date", scans.F.col("date").cast("date"))
    edited = ordered(ed.apply_edits(projected_13, edits))
    assert [row[4] for row in edited][4:13] == [40 + 115 - 300 + 10 * k for k in range(9)]
    assert edited[13:] == [before[13], (*before[14][:3], 8, None), before[15]]
    report = {(row["date"].day, row["field"]): row["outcome"] for row in ed.edit_report(projected_13, edits).collect()}
    assert report == {(5, "demand"): "updated", (15, "demand"): "not_found", (15, "forecast"): "updated", (16, "production_plan"): "not_found"}


def test_a_projected_day_becomes_real_when_it_is_written(spark, projected_13):
    rows = [(day("2024-01-15"), 4, 6)]
    full = ordered(ed.upsert_daily(projected_13, spark.createDataFrame(rows, "date date, demand bigint, production_plan bigint")))
    assert full[13][4] is None and full[14] == (day("2024-01-15"), 4, 6, 112, 132) and full[15][4] is None


def test_planning_over_projections(projected_13):
    planned = forecast_to_plan(projected_13, 5)
    rows = ordered(planned.table)
    assert rows[13:] == [(day(f"2024-01-{n}"), 112, 112, 112, 130) for n in range(14, 19)]
    assert planned.outcomes.first().asDict() == {
        "status": "planned", "points_used": 13, "last_date": day("2024-01-13"), "forecast": 112,
        "first_planned": day("2024-01-14"), "last_planned": day("2024-01-18"), "days_planned": 5,
    }


def test_a_planner_stores_projections_and_goes_on(spark, daily_13, tmp_path):
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily_13)
    planner = Planner(table, as_of="2024-01-07")
    planner.calculate_demand_forecast(periods=3, mode="upsert")
    assert planner.get_latest_inventory().first()[0] == 10
    planner.update_demand("2024-01-05", 300)
    assert planner.get_latest_inventory().first()[0] == -95
    assert values(planner.calculate_demand_forecast(periods=1), "date") == [day("2024-01-14")]
    assert values(planner.forecast_to_plan(14), "status", "days_planned") == [("planned", 14)]
    assert planner.get_daily_data().count() == 27 and planner.get_latest_inventory().first()[0] == -95


def test_every_series_comes_back_with_a_status(spark, many):
    rows, _ = many
    rows = [row for row in rows if row[0] != "s3"] + [("s3", day("2021-01-01") + dt.timedelta(days=k), None if k == 4 else k, k, None, 5) for k in range(12)]
    daily = make_daily(spark, rows, keyed=True)
    planned = forecast_to_plan(daily, 4, method="moving_average", window=2, keys=KEYS)
    smooth = forecast_to_plan(daily, 4, keys=KEYS)
    series = by_series(rows)
    outcomes = {row["series_key"]: row for row in smooth.outcomes.collect()}
    assert outcomes.keys() == series.keys()
    for key, own in series.items():
        gap = any(row[2] is None for row in own)
        status = "missing_demand" if gap else "planned" if len(own) >= 10 else "insufficient_history"
        assert (outcomes[key]["status"], outcomes[key]["points_used"], outcomes[key]["last_date"]) == (status, len(own), own[-1][1])
        assert outcomes[key]["days_planned"] == (4 if status == "planned" else 0)
    marked = smooth.with_status()
    assert marked.filter("status is null").isEmpty()
    kept = {key: sorted(own) for key, own in series.items()}
    back = by_series([tuple(row) for row in marked.select("series_key", *COLUMNS).collect()])
    for key, own in back.items():
        assert own[: len(kept[key])] == kept[key]
        assert len(own) == len(kept[key]) + outcomes[key]["days_planned"]
        assert all(row[2] == row[3] == row[4] == outcomes[key]["forecast"] and row[5] == kept[key][-1][5] for row in own[len(kept[key]) :])
    assert {row["series_key"] for row in smooth.not_planned().collect()} == {k for k, row in outcomes.items() if row["status"] != "planned"}
    # A moving average of two points is only stopped by a gap among them.
    assert {row["status"] for row in planned.outcomes.collect()} == {"planned"}


def test_planning_an_empty_table(spark):
    for keyed, keys in ((False, []), (True, KEYS)):
        planned = forecast_to_plan(make_daily(spark, [], keyed), keys=keys)
        assert planned.table.collect() == []
        assert values(planned.outcomes, "status") == ([] if keys else ["no_history"])


def nearest(dates, wanted, n):
    if wanted in dates:
        return True, None, None
    dates = sorted(dates)
    at = bisect.bisect(dates, wanted) if wanted else 0
    return False, dates[max(at - n, 0) : at], dates[at : at + n]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_nearest_dates_equal_a_search_of_the_whole_list(spark, many, n):
    pick = random.Random(n)
    series = {key: {row[1] for row in own} for key, own in by_series(many[0]).items()}
    asked = [(key, dt.date(2010, 1, 1) + dt.timedelta(days=pick.randrange(12000))) for key in series for _ in range(60)]
    asked += [(key, day) for key, days in series.items() for day in list(days)[:2]] + asked[:5]
    found = scans.lookup_available_dates(many[1], spark.createDataFrame(asked, "series_key string, date date"), KEYS, n)
    got = {(row[0], row[1]): tuple(row)[2:] for row in found.collect()}
    assert got == {(key, wanted): nearest(series[key], wanted, n) for key, wanted in asked}
    dates = set().union(*series.values())
    whole = scans.lookup_available_dates(many[1].drop("series_key"), spark.createDataFrame(asked, "series_key string, date date"), nearest=n)
    assert {row[0]: tuple(row)[1:] for row in whole.collect()} == {wanted: nearest(dates, wanted, n) for _, wanted in asked}


def test_nearest_dates_of_nothing(spark, many):
    asked = spark.createDataFrame([("s1", None), ("nowhere", day("2020-01-01"))], "series_key string, date date")
    rows = scans.lookup_available_dates(many[1], asked, KEYS).collect()
    assert {tuple(row) for row in [(r[0], r[1], r[2], tuple(r[3]), tuple(r[4])) for r in rows]} == {
        ("s1", None, False, (), ()), ("nowhere", day("2020-01-01"), False, (), ()),
    }
    empty = scans.lookup_available_dates(make_daily(spark, []), asked.drop("series_key"), nearest=2)
    assert [(r[1], r[2], r[3]) for r in empty.collect()] == [(False, [], [])] * 2
    with pytest.raises(ValueError, match="nearest"):
        scans.lookup_available_dates(many[1], asked, KEYS, 0)
