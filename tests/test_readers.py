import pytest
from conftest import day, values
from dayplan import Planner, StoredTable
from dayplan.operators import inventory as inv
from dayplan.sources.readers import as_daily, broken_keys

KEYS = ["series_key"]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_files_of_any_kind(spark, daily_13, tmp_path, kind):
    path = str(tmp_path / kind)
    text = daily_13.selectExpr(
        "date_format(date, 'dd-MM-yyyy') as day", "demand", "production_plan as plan", "inventory"
    )
    text.write.format(kind).option("header", True).save(path)
    reader = spark.read.format(kind).option("header", True)
    rows = reader.schema("day string, demand bigint, plan bigint, inventory bigint").load(path)
    daily = as_daily(rows, names={"date": "day", "production_plan": "plan"})
    assert daily.columns == daily_13.columns and daily.dtypes == daily_13.dtypes
    back = inv.recalc_inventory(daily).orderBy("date")
    assert values(back, "inventory") == [10 * i for i in range(1, 14)]
    assert set(values(daily, "forecast")) == {None}


def test_broken_keys_are_listed(spark, many, daily_13):
    assert broken_keys(daily_13).count() == 0 and broken_keys(many[1], KEYS).count() == 0
    twice = daily_13.unionByName(daily_13.filter("date = '2024-01-05'"))
    assert values(broken_keys(twice), "date", "rows") == [(day("2024-01-05"), 2)]
    unnamed = many[1].limit(1).selectExpr("cast(null as string) as series_key", "date")
    assert broken_keys(unnamed, KEYS).count() == 1


def test_planner_over_many_series(spark, many, tmp_path):
    rows, daily = many
    table = StoredTable(spark, str(tmp_path / "daily")).create(daily, layout="series", keys=KEYS, parts=8)
    planner = Planner(table, KEYS)
    last = max(row[1] for row in rows if row[0] == "s5")
    report = planner.update_production_plan(last, 1000, {"series_key": "s5"})
    assert values(report, "series_key", "outcome") == [("s5", "updated")]
    found = planner.get_daily_data(last).filter("series_key = 's5'")
    assert values(found, "production_plan") == [1000]
    assert planner.get_latest_inventory().count() == 7
    assert planner.next_days(3).count() == 21
    planner.forecast_to_plan(2)
    assert planner.get_daily_data().count() == len(rows) + 2 * 4
