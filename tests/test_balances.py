"""Balances cut by year against recalculation of the whole tail."""

import datetime as dt
import random
from pathlib import Path

import pytest
from conftest import COLUMNS, by_series, make_daily
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.sources.balances import BalanceTable
from pyspark.sql import functions as F

KEYS = ["series_key"]
EDITS = "series_key string, date date, field string, value bigint, seq bigint"


def files(table, name="days"):
    root = Path(table.root) / name
    return {int(part.name.split("=")[1]): sorted(f.name for f in part.glob("*.parquet")) for part in root.iterdir() if "=" in part.name}


def same(got, expected, keys=KEYS):
    left, right = ([tuple(r) for r in df.select(*keys, *COLUMNS).collect()] for df in (got, expected))
    assert sorted(left, key=str) == sorted(right, key=str)


def random_edits(spark, rows, seed, n=12):
    pick = random.Random(seed)
    fields = ["demand", "production_plan", "forecast"]
    made = [(*pick.choice(rows)[:2], pick.choice(fields), pick.randrange(300), k) for k in range(n)]
    made += [("nobody", dt.date(2020, 1, 1), "demand", 1, 99), (rows[0][0], dt.date(1990, 1, 1), "demand", 1, 99)]
    return spark.createDataFrame(made, EDITS)


def test_edits_and_recalculations_equal_the_whole_tail(spark, many, tmp_path):
    rows, daily = many
    table = BalanceTable(spark, str(tmp_path / "stale"), KEYS).create(daily)
    same(table.read(), daily)
    expected = daily
    for step in range(3):
        edits = random_edits(spark, rows, step, 6)
        expected = make_daily(spark, ed.apply_edits(expected, edits, KEYS).select("series_key", *COLUMNS).collect(), keyed=True)
        table.apply_edits(edits)
        same(table.read(), expected)
        start = dt.date(2020 + step, 5, 17)
        expected = make_daily(spark, inv.recalc_inventory(expected, start, KEYS).select("series_key", *COLUMNS).collect(), keyed=True)
        table.recalc_inventory(start)
        same(table.read(), expected)


def test_a_clean_table_rewrites_only_the_edited_years(spark, many, tmp_path):
    rows, daily = many
    clean = make_daily(spark, inv.recalc_inventory(daily, None, KEYS).select("series_key", *COLUMNS).collect(), keyed=True)
    table = BalanceTable(spark, str(tmp_path / "clean"), KEYS).create(clean)
    own = by_series(rows)["s6"]
    years = sorted({row[1].year for row in own})
    assert len(years) > 3
    middle = next(row[1] for row in own if row[1].year == years[1])
    edits = spark.createDataFrame([("s6", middle, "demand", 10_000, 1)], EDITS)
    before = files(table)
    assert table.apply_edits(edits) == [years[1]]
    after = files(table)
    assert {year for year in before if before[year] != after[year]} == {years[1]}
    same(table.read(), ed.apply_edits(clean, edits, KEYS))
    # The days that are read for the change are those of the year alone.
    plan = table.days().filter(F.col("year").isin([years[1]]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"= {years[1]})" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # A recalculation of what follows from the flows already changes one year at most, and no balance.
    expected = [tuple(row) for row in table.read().collect()]
    assert table.recalc_inventory(dt.date(years[2], 3, 1)) == [years[2]] or len(by_series(rows)) > 1
    assert sorted([tuple(row) for row in table.read().collect()], key=str) == sorted(expected, key=str)
    assert table.apply_edits(edits.filter("false")) == []
    assert table.recalc_inventory("junk") == []


def test_forecasts_and_projections(spark, many, tmp_path):
    rows, daily = many
    clean = inv.recalc_inventory(daily, None, KEYS)
    projected = fc.persist_forecast(clean, fc.future_forecast_rows(clean, 40, keys=KEYS), KEYS, "upsert")
    projected = make_daily(spark, projected.select("series_key", *COLUMNS).collect(), keyed=True)
    table = BalanceTable(spark, str(tmp_path / "ahead"), KEYS).create(projected)
    same(table.read(), projected)
    edits = random_edits(spark, [row for row in rows if row[0] in ("s5", "s6")], 5)
    ahead = projected.filter("demand is null").selectExpr("series_key", "date", "'demand' as field", "7L as value", "200L as seq")
    edits = edits.unionByName(ahead).unionByName(ahead.selectExpr("series_key", "date", "'forecast' as field", "8L as value", "201L as seq"))
    table.apply_edits(edits)
    same(table.read(), ed.apply_edits(projected, edits, KEYS))


def test_one_series_without_keys_and_missing_numbers(spark, daily_13, tmp_path):
    table = BalanceTable(spark, str(tmp_path / "single")).create(daily_13)
    same(table.read(), daily_13, [])
    edit = ed.one_edit(spark, "2024-01-05", "demand", 300)
    assert table.apply_edits(edit) == [2024]
    same(table.read(), ed.apply_edits(daily_13, edit), [])
    gap = daily_13.selectExpr("date", "if(day(date) = 9, null, demand) as demand", "production_plan", "forecast", "inventory")
    table = BalanceTable(spark, str(tmp_path / "gap")).create(gap)
    with pytest.raises(Exception, match="demand is NULL"):
        table.recalc_inventory("2024-01-05")
    same(table.read(), gap, [])
    table.recalc_inventory("2024-01-05", on_null="zero")
    same(table.read(), inv.recalc_inventory(gap, "2024-01-05", on_null="zero"), [])
