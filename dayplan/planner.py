"""The planning tools over one stored daily table.

Reads return DataFrames, which are not to be used after a change.  Changes rewrite the
partitions they touch in one job, so one that fails leaves the table as it was.  A table has
one writer at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.operators import scans, summary
from dayplan.plans.forecast_to_plan import forecast_to_plan
from dayplan.schema import DEMAND, FORECAST, PLAN, Keys, date_value
from dayplan.sources.staging import stage
from dayplan.sources.tables import StoredTable
from dayplan.streaming.edits import write_edits

Day = str | dt.date


class Planner:
    """``as_of`` is the day that words like "today" refer to; by default the current one.

    Edit lists and reports are small, so reading one outcome row on the driver is fine;
    the table itself never passes through it.
    """

    def __init__(self, table: StoredTable, keys: Keys = (), as_of: Day | None = None):
        self.table = table
        self.keys = list(keys)
        self.as_of = as_of

    @property
    def daily(self) -> DataFrame:
        return self.table.read()

    def _today(self):
        return F.current_date() if self.as_of is None else self.as_of

    def get_daily_data(self, date: Day | None = None) -> DataFrame:
        if date is None:
            return scans.scan_daily(self.daily, self.keys)
        return scans.lookup_daily(self.table.with_layout(), date, self.keys, self._today())

    def get_available_dates(self, requested: DataFrame) -> DataFrame:
        return scans.lookup_available_dates(self.daily, requested, self.keys)

    def get_production_summary(self) -> DataFrame:
        return summary.production_summary(self.daily, self.keys)

    def get_demand_summary(self) -> DataFrame:
        return summary.demand_summary(self.daily, self.keys)

    def get_inventory_summary(self) -> DataFrame:
        return summary.inventory_summary(self.daily, self.keys)

    def get_latest_inventory(self) -> DataFrame:
        return summary.latest_inventory(self.daily, self.keys)

    def get_kpi_cards(self) -> DataFrame:
        return summary.kpi_cards(self.daily, self.keys)

    def get_stockouts(self) -> DataFrame:
        return inv.stockouts(self.daily, self.keys)

    def propose_production_plan_for_stockouts(self, cover_backlog: bool = False) -> DataFrame:
        return inv.stockout_proposals(self.daily, self.keys, cover_backlog)

    def update(self, edits: DataFrame) -> DataFrame:
        """Apply an edit list and report each edit's outcome."""
        report = stage(ed.edit_report(self.daily, edits, self.keys), "report")
        if not report.filter("outcome = 'updated'").isEmpty():
            write_edits(self.table, edits, self.keys)
        return report

    def _update_one(self, date: Day, field: str, value: int, series: dict | None) -> DataFrame:
        spark = self.table.spark
        return self.update(ed.one_edit(spark, date, field, value, series, self._today()))

    def update_production_plan(self, date: Day, value: int, series: dict | None = None) -> DataFrame:
        return self._update_one(date, PLAN, value, series)

    def update_demand(self, date: Day, value: int, series: dict | None = None) -> DataFrame:
        return self._update_one(date, DEMAND, value, series)

    def update_forecast(self, date: Day, value: int, series: dict | None = None) -> DataFrame:
        return self._update_one(date, FORECAST, value, series)

    def increase_all_demand(self, offset: int) -> DataFrame:
        """Shift every demand and report how many days changed."""
        report = stage(ed.shift_outcome(self.daily, offset), "report")
        if report.first()["changed"]:
            self.table.overwrite(ed.shift_demand(self.daily, offset, self.keys))
        return report

    def clear_all_forecast(self) -> DataFrame:
        report = stage(ed.clear_all_outcome(self.daily), "report")
        self.table.overwrite(ed.clear_all_forecast(self.daily))
        return report

    def clear_forecast_range(self, start_date: Day, end_date: Day | None = None) -> DataFrame:
        """Clear a range and report the outcome; a range without forecasts changes nothing.

        Laid out by date, only the partitions of the range are rewritten.
        """
        today = self._today()
        report = stage(ed.clear_forecast_outcome(self.daily, start_date, end_date, today), "report")
        if report.first()["cleared"]:
            first = date_value(start_date, today)
            last = None if end_date is None else date_value(end_date, today)
            held = self.table.with_layout().filter(self.table.between(first, last))
            self.table.overwrite(ed.clear_forecast_range(held, start_date, end_date, today))
        return report

    def calculate_demand_forecast(
        self,
        method: str = "exponential_smoothing",
        periods: int = 7,
        start_date: Day | None = None,
        mode: str = "update",
    ) -> DataFrame:
        """Forecast, store the forecast, and return its dated rows."""
        self._readable(start_date)
        rows = stage(
            fc.future_forecast_rows(
                self.daily, periods, start_date, method, keys=self.keys, as_of=self._today()
            ),
            "forecast",
        )
        self.table.change(rows, lambda daily: fc.persist_forecast(daily, rows, self.keys, mode))
        return rows

    def forecast_to_plan(self, periods: int = 7, start_date: Day | None = None) -> DataFrame:
        """Forecast, plan production to match, and return the outcome of every series."""
        self._readable(start_date)
        planned = forecast_to_plan(
            self.daily, periods, start_date, keys=self.keys, as_of=self._today()
        )
        outcomes = stage(planned.outcomes, "outcomes")
        self.table.change(planned.changes, lambda daily: ed.upsert_daily(daily, planned.changes, self.keys))
        return outcomes

    def _readable(self, date: Day | None) -> None:
        """A date that cannot be read is an error, not an empty result."""
        if isinstance(date, str):
            found = self.table.spark.range(1).select(date_value(date, self._today())).first()[0]
            if found is None:
                raise ValueError(ed.UNREADABLE_TEXT.format(date))

    def write_days(self, days: DataFrame, recalc_tail: bool = True) -> None:
        """Add or overwrite whole days."""
        self.table.change(days, lambda daily: ed.upsert_daily(daily, days, self.keys, recalc_tail))

    def next_days(self, days: int, start_date: Day | None = None) -> DataFrame:
        """The dates to fill when the calendar is extended."""
        return ed.extend_calendar(self.daily, days, start_date, self.keys, self._today())

    def delete_all_data(self) -> DataFrame:
        report = stage(ed.delete_all_daily(self.daily)[1], "report")
        self.table.clear()
        return report

    def history_bounds(self) -> DataFrame:
        return summary.history_bounds(self.daily, self.keys)
