"""Summary figures: one pass each, with partial aggregation before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayplan.functions.numbers import half_even
from dayplan.schema import DEMAND, INVENTORY, PLAN, Keys, bigint, real_day


def column_summary(daily: DataFrame, column: str, label: str, keys: Keys = ()) -> DataFrame:
    """Total, average, smallest and largest; 0 where there is no value at all."""
    zero = F.lit(0).cast("bigint")
    return daily.groupBy(*keys).agg(
        F.coalesce(bigint(F.sum(column)), zero).alias(f"total_{label}"),
        F.coalesce(half_even(F.avg(column)), F.lit(0.0)).alias(f"average_{label}"),
        F.coalesce(bigint(F.min(column)), zero).alias(f"min_{label}"),
        F.coalesce(bigint(F.max(column)), zero).alias(f"max_{label}"),
    )


def production_summary(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    return column_summary(daily, PLAN, "production", keys)


def demand_summary(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    return column_summary(daily, DEMAND, "demand", keys)


def inventory_summary(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """The total is a sum of daily balances."""
    return column_summary(daily, INVENTORY, "inventory", keys)


def latest_inventory(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Inventory of the last real day, without sorting; 0 for an empty table."""
    last = F.coalesce(bigint(F.max_by(INVENTORY, real_day())), F.lit(0).cast("bigint"))
    return daily.groupBy(*keys).agg(last.alias("latest_inventory"))


def kpi_cards(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Total production, total demand and projected inventory in one aggregate."""
    zero = F.lit(0).cast("bigint")
    return daily.groupBy(*keys).agg(
        F.coalesce(bigint(F.sum(PLAN)), zero).alias("total_production"),
        F.coalesce(bigint(F.sum(DEMAND)), zero).alias("total_demand"),
        F.coalesce(bigint(F.max_by(INVENTORY, real_day())), zero).alias("projected_inventory"),
    )


def history_bounds(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """First and last real date of each series, and how many such days it has."""
    return daily.groupBy(*keys).agg(
        F.min(real_day()).alias("first_date"),
        F.max(real_day()).alias("last_date"),
        bigint(F.count(real_day())).alias("days"),
    )
