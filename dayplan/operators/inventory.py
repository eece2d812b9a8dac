"""Cumulative inventory and what follows from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.operators.running import running_total, running_total_by_series
from dayplan.schema import (
    DATE,
    DEMAND,
    INVENTORY,
    PLAN,
    Keys,
    bigint,
    date_value,
    int_or_fail,
    is_projected,
    real_day,
)

Start = str | dt.date | Column | DataFrame | None


def net_flow(on_null: str = "error") -> Column:
    """What a day adds to the stock."""
    return int_or_fail(F.col(PLAN), PLAN, on_null) - int_or_fail(F.col(DEMAND), DEMAND, on_null)


def opening_balance(earlier: DataFrame, keys: Keys = (), on_null: str = "error") -> DataFrame:
    """Stored inventory of each series on its latest day in ``earlier``.

    The stored value counts even if it is stale.  No earlier day means no row or an
    opening of 0; projected days do not count.
    """
    latest = earlier.groupBy(*keys).agg(
        F.max_by(INVENTORY, real_day()).alias("opening"), F.max(real_day()).alias("_last")
    )
    balance = F.when(F.col("_last").isNull(), F.lit(0)).otherwise(
        int_or_fail(F.col("opening"), INVENTORY, on_null)
    )
    return latest.select(*keys, bigint(balance).alias("opening"))


def renumber(
    active: DataFrame,
    earlier: DataFrame | None,
    keys: Keys = (),
    on_null: str = "error",
    by_series: bool = False,
    addends: DataFrame | None = None,
) -> DataFrame:
    """``active`` with inventory carried forward from the last day of ``earlier``.

    Projected days move no stock and keep their empty balance.
    """
    opening = None if earlier is None else opening_balance(earlier, keys, on_null)
    rows = active.withColumn("_projected", is_projected())
    flow = F.when(F.col("_projected"), F.lit(0).cast("bigint")).otherwise(net_flow(on_null))
    if by_series:
        out = running_total_by_series(rows, keys, flow, INVENTORY, opening)
    else:
        out = running_total(rows, keys, flow, INVENTORY, opening, addends)
    balance = F.when(~F.col("_projected"), F.col(INVENTORY))
    return out.withColumn(INVENTORY, balance).drop("_projected")


def split_at(
    daily: DataFrame, starts: DataFrame, keys: Keys = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows from the start of their series on, rows before it, and all rows but the first kind.

    ``starts`` has ``(keys..., start)``; a series without a start has only rows of the
    third kind.  These are joins on the same keys whatever the number of starts: Spark
    broadcasts a short list, and otherwise shuffles the daily rows once for all readers
    whose exchanges are alike.
    """
    if not keys:
        begin = starts.select("start").scalar()
        day = F.col(DATE)
        rest = (day < begin) | begin.isNull()
        return daily.filter(day >= begin), daily.filter(day < begin), daily.filter(rest)
    first = starts.select(*[F.col(key).alias(f"_at_{key}") for key in keys], "start")
    same = [F.col(key) == F.col(f"_at_{key}") for key in keys]
    reached, not_yet = F.col(DATE) >= F.col("start"), F.col(DATE) < F.col("start")
    active = daily.join(first, [*same, reached]).select(*daily.columns)
    earlier = daily.join(first, [*same, not_yet]).select(*daily.columns)
    return active, earlier, daily.join(first, [*same, reached], "left_anti")


def recalc_inventory(
    daily: DataFrame,
    start: Start = None,
    keys: Keys = (),
    on_null: str = "error",
    by_series: bool = False,
) -> DataFrame:
    """Carry inventory forward from ``start``; earlier rows keep what they hold.

    ``start`` is one date for all series, a DataFrame ``(keys..., start)`` with a
    date per series (series without one are left alone), or None for the first day.
    Rows that are not recalculated pass through without a shuffle.
    """
    if start is None:
        return renumber(daily, None, keys, on_null, by_series)
    if isinstance(start, DataFrame):
        active, earlier, rest = split_at(daily, start, keys)
    else:
        begin = date_value(start)
        active = daily.filter(F.col(DATE) >= begin)
        earlier = daily.filter(F.col(DATE) < begin)
        rest = daily.filter((F.col(DATE) < begin) | begin.isNull())
    return renumber(active, earlier, keys, on_null, by_series).unionByName(rest)


def stockouts(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Days whose inventory is zero or negative, in order."""
    return (
        daily.filter(F.col(INVENTORY) <= 0)
        .select(*keys, DATE, DEMAND, PLAN, INVENTORY)
        .orderBy(*keys, DATE)
    )


def stockout_proposals(
    daily: DataFrame, keys: Keys = (), cover_backlog: bool = False, on_null: str = "error"
) -> DataFrame:
    """A production plan for each stockout day: the demand of that day.

    ``cover_backlog`` proposes what brings the balance to zero instead.
    """
    plan, demand = int_or_fail(F.col(PLAN), PLAN, on_null), int_or_fail(F.col(DEMAND), DEMAND, on_null)
    proposed = plan - F.col(INVENTORY) if cover_backlog else demand
    left = F.col(INVENTORY) - plan + proposed if cover_backlog else proposed - demand
    return stockouts(daily, keys).select(
        *keys,
        DATE,
        demand.alias(DEMAND),
        plan.alias("current_production_plan"),
        proposed.alias("proposed_production_plan"),
        left.alias("resulting_inventory"),
    )
