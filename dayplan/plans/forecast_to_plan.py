"""From a demand forecast to a production plan in one step."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.functions.numbers import stored_whole
from dayplan.operators.edits import upsert_daily
from dayplan.operators.forecast import dated_rows, forecast_level, history_until
from dayplan.schema import DATE, DEMAND, FORECAST, PLAN, Keys, bigint
from dayplan.sources.staging import stage

#: Statuses besides those of the forecast.
PLANNED, NO_HISTORY = "planned", "no_history"


@dataclass
class Planned:
    """A table after planning, and what became of each of its series.

    ``table`` is the whole daily table.  ``outcomes`` has one row per series: ``status``
    (``planned``, or why there is no plan: ``insufficient_history``, ``missing_demand``,
    ``no_history``), ``points_used``, ``last_date`` of the history, the stored ``forecast``,
    and ``first_planned``, ``last_planned`` and ``days_planned``.  ``changes`` are the planned days.
    """

    table: DataFrame
    outcomes: DataFrame
    changes: DataFrame
    keys: Keys = ()

    def with_status(self) -> DataFrame:
        """The whole table, each row with the status of its series."""
        if not self.keys:
            return self.table.withColumn("status", self.outcomes.select("status").scalar())
        names = self.outcomes.select(*[F.col(key).alias(f"_of_{key}") for key in self.keys], "status")
        same = [F.col(key) == F.col(f"_of_{key}") for key in self.keys]
        return self.table.join(names, same, "left").select(*self.table.columns, "status")

    def not_planned(self) -> DataFrame:
        return self.outcomes.filter(F.col("status") != PLANNED)


def plan_outcomes(
    daily: DataFrame, level: DataFrame, changes: DataFrame, keys: Keys = ()
) -> DataFrame:
    """One row per series of ``daily``, whether it has a forecast level and planned days or not."""
    series = daily.groupBy(*keys).agg(F.count("*").alias("_rows"))
    days = changes.groupBy(*keys).agg(
        F.min(DATE).alias("first_planned"),
        F.max(DATE).alias("last_planned"),
        bigint(F.count("*")).alias("days_planned"),
    )
    if keys:
        joined = series.join(level, list(keys), "left").join(days, list(keys), "left")
    else:  # one row each; a level is missing where there is no history
        found = level.agg(*[F.first(name).alias(name) for name in level.columns])
        joined = series.join(found, F.lit(True)).join(days, F.lit(True))
    planned = F.col("days_planned") > 0
    status = F.when(planned, PLANNED).otherwise(F.coalesce("status", F.lit(NO_HISTORY)))
    return joined.select(
        *keys,
        status.alias("status"),
        F.coalesce(bigint(F.col("points_used")), F.lit(0).cast("bigint")).alias("points_used"),
        "last_date",
        F.when(planned, stored_whole(F.col(FORECAST))).alias(FORECAST),
        "first_planned",
        "last_planned",
        F.coalesce("days_planned", F.lit(0).cast("bigint")).alias("days_planned"),
    )


def forecast_to_plan(
    daily: DataFrame,
    periods: int = 7,
    start: str | dt.date | Column | None = None,
    method: str = "exponential_smoothing",
    alpha: float = 0.5,
    window: int = 3,
    keys: Keys = (),
    as_of: str | dt.date | None = None,
) -> Planned:
    """Forecast, take the forecast as demand and produce exactly that, renumber the stock.

    Series without a forecast keep their rows, and say why in their outcome.  Projected days
    are no history; where planning reaches them they become real.  Levels (one row per
    series) and forecast days (series times periods) are read by several joins, so they are
    written once.
    """
    history = daily if start is None else history_until(daily, start, keys, as_of=as_of)
    level = stage(forecast_level(history, method, alpha, window, keys), "levels")
    ahead = dated_rows(level, periods, start, keys, as_of).filter(F.col(FORECAST).isNotNull())
    value = stored_whole(F.col(FORECAST))
    changes = stage(
        ahead.select(*keys, DATE, value.alias(DEMAND), value.alias(PLAN), value.alias(FORECAST)),
        "forecast",
    )
    outcomes = plan_outcomes(daily, level, changes, keys)
    return Planned(upsert_daily(daily, changes, keys), outcomes, changes, keys)
