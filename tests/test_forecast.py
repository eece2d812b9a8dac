import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import by_series, day, make_daily, values
from dayplan.functions.numbers import half_even, half_even_scaled
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.plans.forecast_to_plan import forecast_to_plan
from pyspark.sql import functions as F

KEYS = ["series_key"]


def smooth(demands, alpha):
    """Fit a line through the first ten points, then apply the recursion."""
    if len(demands) < 10:
        return None
    ys = demands[:10]
    mean_y, mean_x = sum(ys) / 10, 5.5
    slope = sum((x - mean_x) * (y - mean_y) for x, y in zip(range(1, 11), ys)) / 82.5
    level = mean_y - slope * mean_x
    for y in demands:
        level = alpha * y + (1 - alpha) * level
    return level


@pytest.mark.parametrize("rows, expected", [(13, 112.0), (10, 109.0)])
def test_smoothing_of_the_small_table(daily_13, rows, expected):
    history = daily_13.filter(f"date <= '2024-01-{rows:02d}'")
    out = fc.ses_forecast(history, periods=3).orderBy("period").collect()
    assert [tuple(row) for row in out] == [(n, expected, "ok") for n in (1, 2, 3)]


@pytest.mark.parametrize("rows, expected", [(13, 112.0), (10, 109.0), (2, 101.5)])
def test_moving_average_of_the_small_table(daily_13, rows, expected):
    history = daily_13.filter(f"date <= '2024-01-{rows:02d}'")
    assert values(fc.moving_average_forecast(history, periods=2), "forecast") == [expected] * 2


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.5, 1.0])
def test_smoothing_equals_the_recursion(many, alpha):
    rows, daily = many
    got = {row["series_key"]: row for row in fc.smoothing_level(daily, alpha, KEYS).collect()}
    for name, series in by_series(rows).items():
        level = smooth([row[2] for row in series], alpha)
        if level is None:
            assert got[name]["forecast"] is None
            assert got[name]["status"] == "insufficient_history"
        else:
            assert got[name]["forecast"] == pytest.approx(level, abs=0.006)
        assert got[name]["points_used"] == len(series)
        assert got[name]["last_date"] == series[-1][1]


@pytest.mark.parametrize("window", [1, 3, 30, 500, 2000])
def test_moving_average_equals_the_last_values(many, window):
    rows, daily = many
    level = fc.moving_average_level(daily, window, KEYS).collect()
    got = {row["series_key"]: row["forecast"] for row in level}
    for name, series in by_series(rows).items():
        last = [row[2] for row in series][-window:]
        assert got[name] == pytest.approx(sum(last) / len(last), abs=0.006)


@pytest.mark.parametrize("window", [1, 2, 3, 30, 500])
def test_rolling_mean_equals_the_slices(many, window):
    rows, daily = many
    out = fc.moving_average_series(daily, window, KEYS).collect()
    got = {(row["series_key"], row["date"]): row["moving_average"] for row in out}
    assert len(got) == len(rows)
    for name, series in by_series(rows).items():
        for at, row in enumerate(series):
            if at + 1 < window:
                assert got[name, row[1]] is None
            else:
                part = [held[2] for held in series[at + 1 - window : at + 1]]
                assert got[name, row[1]] == pytest.approx(sum(part) / window, abs=0.006)


def test_missing_demand(spark, daily_13):
    rows = [tuple(row) for row in daily_13.orderBy("date").collect()]
    rows[11] = (rows[11][0], None, *rows[11][2:])
    gap = make_daily(spark, rows)
    assert values(fc.ses_forecast(gap, periods=1), "forecast", "status") == [(None, "missing_demand")]
    average = fc.moving_average_forecast(gap, periods=1)
    assert values(average, "forecast", "status") == [(None, "missing_demand")]
    assert values(fc.moving_average_forecast(gap, 1, 1), "forecast") == [113.0]
    rolling = values(fc.moving_average_series(gap).orderBy("date"), "moving_average")
    assert rolling[:2] == [None, None] and rolling[11:] == [None, None] and rolling[10] == 110.0


def test_nothing_to_forecast(daily_13):
    empty = daily_13.filter("false")
    assert fc.ses_forecast(empty).count() == 0
    assert fc.moving_average_forecast(empty).count() == 0
    assert fc.forecast_from_date(empty, "2024-01-01").count() == 0
    assert fc.ses_forecast(daily_13, periods=0).count() == 0


def test_history_ends_on_the_start_day(daily_13):
    cut = fc.forecast_from_date(daily_13, "2024-01-10", 2)
    assert values(cut, "forecast") == [109.0, 109.0]
    before = fc.forecast_from_date(daily_13, "2024-01-11", 2, include_start=False)
    assert values(before, "forecast") == [109.0, 109.0]
    assert values(fc.forecast_from_date(daily_13, "2024-01-10", 1, "moving_average"), "forecast") == [109.0]


def test_a_start_before_the_data_uses_all_of_it(daily_13):
    assert values(fc.forecast_from_date(daily_13, "2023-12-25", 2), "forecast") == [112.0, 112.0]
    assert fc.forecast_from_date(daily_13, "junk", 2).count() == 0
    dated = fc.future_forecast_rows(daily_13, 2, "2023-12-25").orderBy("date")
    assert values(dated, "date") == [day("2023-12-25"), day("2023-12-26")]


def test_history_cut_by_series(many):
    rows, daily = many
    cut = day("2020-03-01")
    got = {
        row["series_key"]: row["points_used"]
        for row in fc.smoothing_level(fc.history_until(daily, cut, KEYS), keys=KEYS).collect()
    }
    for name, series in by_series(rows).items():
        kept = [row for row in series if row[1] <= cut] or series
        assert got[name] == len(kept)


def test_unknown_method_means_smoothing(daily_13):
    assert values(fc.forecast_level(daily_13, "other"), "forecast") == [112.0]


def test_stored_forecasts_of_the_small_table(daily_13):
    known = daily_13.filter("date <= '2024-01-10'")
    made = fc.future_forecast_rows(known, 3)
    stored = fc.persist_forecast(daily_13, made).orderBy("date")
    assert values(stored, "forecast")[-3:] == [109, 109, 109]
    made = fc.future_forecast_rows(known, 2, "2024-01-11")
    stored = fc.persist_forecast(daily_13, made).orderBy("date")
    assert values(stored, "forecast")[-3:] == [109, 109, 0]


def test_chart_lines(daily_13):
    lines = fc.demand_forecast_series(daily_13)
    assert lines.filter("series = 'Historical Demand'").count() == 13
    ahead = lines.filter("series = 'Forecast'").orderBy("date")
    assert values(ahead, "date")[0] == day("2024-01-14") and values(ahead, "value") == [112.0] * 5


def test_forecast_to_plan(daily_13, many):
    planned = forecast_to_plan(daily_13, periods=4)
    ahead = planned.table.filter("date > '2024-01-13'").orderBy("date").collect()
    assert [tuple(row)[1:] for row in ahead] == [(112, 112, 112, 10)] * 4
    rows, daily = many
    out = forecast_to_plan(daily, 5, keys=KEYS).table
    series = by_series(rows)
    long_enough = [name for name, held in series.items() if len(held) >= 10]
    assert out.count() == len(rows) + 5 * len(long_enough)
    for row in out.collect():
        last = series[row["series_key"]][-1]
        if row["date"] > last[1]:
            assert row["inventory"] == last[5] and row["demand"] == row["production_plan"]
    assert inv.stockouts(out, KEYS).count() >= sum(1 for row in rows if row[5] <= 0)


def test_forecast_as_edits(spark, daily_13):
    change = ed.one_edit(spark, dt.date(2024, 1, 13), "forecast", 5)
    assert values(ed.apply_edits(daily_13, change).orderBy("date"), "forecast")[-1] == 5


def test_rounding_takes_the_double_for_what_it_is(spark):
    pick = random.Random(31)
    values_ = [2.675, 74.115, 0.125, 0.375, -2.675, -0.125, 1.005, 1e300, -1e16, 0.0, float("inf"), None]
    values_ += [pick.randrange(-(10**7), 10**7) / 1000 for _ in range(3000)]
    values_ += [pick.randrange(-(10**6), 10**6) / pick.randrange(1, 400) for _ in range(3000)]
    frame = spark.createDataFrame([(x,) for x in values_], "x double")
    rows = frame.select("x", half_even(F.col("x")).alias("exact"), half_even_scaled(F.col("x")).alias("scaled")).collect()
    for row in rows:
        if row.x is None or math.isinf(row.x):
            assert row.exact == row.x == row.scaled
        else:
            assert row.exact == round(row.x, 2)
            if abs(row.x) < 1e12:
                assert row.scaled == float(np.round(np.float64(row.x), 2))
    found = {row.x: (row.exact, row.scaled) for row in rows}
    assert found[2.675] == (2.67, 2.68) and found[0.125] == (0.12, 0.12)


@pytest.mark.parametrize("window", [2, 30, 365, 366, 400, 1000])
def test_wide_windows_cross_years_and_gaps(many, window):
    rows, daily = many
    holed = daily.withColumn("demand", F.when(F.dayofmonth("date") != 29, F.col("demand")))
    out = fc.moving_average_series(holed, window, KEYS).collect()
    got = {(row["series_key"], row["date"]): row["moving_average"] for row in out}
    assert len(got) == len(out) == len(rows)
    for key, own in by_series(rows).items():
        demand = [None if row[1].day == 29 else row[2] for row in own]
        for at, row in enumerate(own):
            part = demand[max(at + 1 - window, 0) : at + 1]
            want = None if len(part) < window or None in part else float(np.round(sum(part) / window, 2))
            assert got[key, row[1]] == want
