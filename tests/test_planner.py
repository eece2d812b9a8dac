import pytest
from conftest import day, values
from dayplan import Planner, StoredTable


@pytest.fixture
def planner(spark, daily_13, tmp_path):
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily_13)
    return Planner(table, as_of="2024-01-07")


def forecasts(planner):
    return values(planner.get_daily_data(), "forecast")


def test_reads(planner):
    assert planner.get_daily_data().count() == 13
    assert values(planner.get_daily_data("today"), "demand") == [107]
    assert planner.get_daily_data("junk").count() == 0
    assert planner.get_production_summary().first()["total_production"] == 1521
    assert planner.get_demand_summary().first()["average_demand"] == 107.0
    assert planner.get_inventory_summary().first()["total_inventory"] == 130
    assert planner.get_latest_inventory().first()[0] == 10
    assert tuple(planner.get_kpi_cards().first()) == (1521, 1391, 10)
    assert planner.history_bounds().first()["days"] == 13
    assert values(planner.next_days(1), "date") == [day("2024-01-14")]


def test_an_edit_is_published_with_its_recalculation(planner):
    assert values(planner.update_demand("05-01-2024", 300), "outcome") == ["updated"]
    assert values(planner.get_daily_data(), "inventory")[4:6] == [-175, -165]
    assert planner.get_stockouts().count() == 9
    assert planner.propose_production_plan_for_stockouts().count() == 9
    planner.update_production_plan("yesterday", 500)
    assert values(planner.get_daily_data(), "inventory")[5] == 500 - 106 - 175


def test_an_edit_of_a_missing_day_publishes_nothing(planner):
    before = planner.get_daily_data().inputFiles()
    assert values(planner.update_demand("2030-01-05", 300), "outcome") == ["not_found"]
    assert values(planner.update_demand("junk", 300), "outcome", "message") == [("invalid_date", "The date could not be read: NULL")]
    for change in (planner.calculate_demand_forecast, planner.forecast_to_plan):
        with pytest.raises(ValueError, match="could not be read: junk"):
            change(start_date="junk")
    assert planner.get_daily_data().inputFiles() == before


def test_a_shift(planner):
    assert tuple(planner.increase_all_demand(0).first()) == (0, "Offset is zero; no changes made.")
    report = planner.increase_all_demand(50).first()
    assert tuple(report) == (13, "Demand increased by 50 units for 13 days. Inventory recalculated cumulatively.")
    assert values(planner.get_daily_data(), "inventory")[-1] == -520


def test_forecasts_are_cleared_in_a_range(planner):
    for date, value in [("2024-01-11", 10), ("2024-01-12", 20), ("2024-01-13", 30)]:
        planner.update_forecast(date, value)
    planner.clear_forecast_range("2024-01-12", "2024-01-13")
    assert forecasts(planner)[-3:] == [10, None, None]
    before = planner.get_daily_data().inputFiles()
    report = planner.clear_forecast_range("2025-01-01", "2025-01-05")
    assert report.first()["message"] == "No forecast values found in the specified date range."
    assert planner.get_daily_data().inputFiles() == before
    assert tuple(planner.clear_all_forecast().first()) == (11, "All forecast values cleared.")
    assert set(forecasts(planner)) == {None}


def test_a_forecast_is_stored(planner):
    made = planner.calculate_demand_forecast(periods=3, start_date="11-01-2024")
    assert values(made, "forecast") == [110.0] * 3
    assert forecasts(planner)[-3:] == [110] * 3
    planner.calculate_demand_forecast("moving_average", 2)
    assert planner.get_daily_data().count() == 13
    planner.calculate_demand_forecast("moving_average", 2, mode="upsert")
    assert forecasts(planner)[-2:] == [112, 112]


def test_forecast_and_plan(planner):
    assert values(planner.forecast_to_plan(3), "status") == ["planned"]
    assert planner.get_stockouts().count() == 0
    rows = values(planner.get_daily_data(), "production_plan", "inventory")
    assert rows[-3:] == [(112, 10)] * 3


def test_days_are_written_and_deleted(spark, planner):
    rows = [(day("2024-01-14"), 4, 5, 6)]
    planner.write_days(
        spark.createDataFrame(rows, "date date, demand bigint, production_plan bigint, forecast bigint")
    )
    assert values(planner.get_daily_data(), "inventory")[-1] == 11
    assert planner.delete_all_data().first()["rows_removed"] == 14
    assert planner.get_daily_data().count() == 0
    assert planner.increase_all_demand(5).first()["message"] == "No data available to update."
    planner.write_days(
        spark.createDataFrame(rows, "date date, demand bigint, production_plan bigint, forecast bigint")
    )
    assert values(planner.get_daily_data("14/1/2024"), "inventory") == [1]
