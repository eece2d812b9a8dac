"""Reads of the daily table: projections, filters and date lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.operators.running import YEAR, running_total, with_year
from dayplan.schema import (
    DAILY_COLUMNS,
    DATE,
    DEMAND,
    FORECAST,
    Keys,
    bigint,
    date_value,
    is_projected,
)
from dayplan.sources.tables import LAYOUTS

Day = str | dt.date | Column


def scan_daily(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Every row, the five daily columns, in order."""
    return daily.select(*keys, *DAILY_COLUMNS).orderBy(*keys, DATE)


def lookup_daily(daily: DataFrame, date: Day, keys: Keys = (), as_of: Day | None = None) -> DataFrame:
    """Rows of one date; text that is not a date finds nothing."""
    found = rows_in_range(daily, date, date, as_of)
    return found.select(*keys, *DAILY_COLUMNS)


def rows_in_range(
    daily: DataFrame, start: Day, end: Day | None = None, as_of: Day | None = None
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; no ``end`` means no upper limit.

    On a stored table read with its month or year column, whole partitions outside the
    range are pruned.
    """
    first = date_value(start, as_of)
    rows = daily.filter(F.col(DATE) >= first)
    parts = [(name, form) for name, form in LAYOUTS.items() if name in daily.columns]
    for name, form in parts:
        rows = rows.filter(F.col(name) >= F.date_format(first, form))
    if end is not None:
        last = date_value(end, as_of)
        rows = rows.filter(F.col(DATE) <= last)
        for name, form in parts:
            rows = rows.filter(F.col(name) <= F.date_format(last, form))
    return rows


def forecast_rows_in_range(
    daily: DataFrame, start: Day, end: Day | None = None, keys: Keys = (), as_of: Day | None = None
) -> DataFrame:
    """How many rows of the range hold a forecast."""
    rows = rows_in_range(daily, start, end, as_of)
    return rows.groupBy(*keys).agg(bigint(F.count(FORECAST)).alias("forecast_rows"))


def year_rows(daily: DataFrame, nearest: int, keys: Keys = ()) -> DataFrame:
    """One row per series and year: its dates (at most 366), and the ends that other years borrow.

    ``tail`` holds the last ``nearest`` dates up to the end of the year, ``head`` the first
    ones from its beginning on, both with the years before and after where this one is short.
    """
    years = (
        with_year(daily.select(*keys, DATE).filter(F.col(DATE).isNotNull()))
        .groupBy(*keys, YEAR)
        .agg(F.sort_array(F.collect_set(DATE)).alias("dates"))
    )
    series = W.partitionBy(*keys).orderBy(YEAR)
    # A year has a date at least, so that this many years hold enough of them.
    before, after = series.rowsBetween(1 - nearest, 0), series.rowsBetween(0, nearest - 1)
    lasts = F.flatten(F.collect_list(last_of(F.col("dates"), nearest)).over(before))
    firsts = F.flatten(F.collect_list(F.slice("dates", 1, nearest)).over(after))
    return years.select(
        *keys, YEAR, "dates", last_of(lasts, nearest).alias("tail"), F.slice(firsts, 1, nearest).alias("head")
    )


def last_of(dates: Column, count: int) -> Column:
    return F.slice(dates, F.greatest(F.size(dates) - count, F.lit(0)) + 1, F.lit(count))


def lookup_available_dates(
    daily: DataFrame, requested: DataFrame, keys: Keys = (), nearest: int = 5
) -> DataFrame:
    """Requested dates, each with a found flag; a miss carries the nearest dates on offer.

    ``requested`` has ``(keys..., date)``; ``dates_before`` and ``dates_after`` of a miss hold
    up to ``nearest`` dates of its series on either side, in order, and are NULL for a hit.
    A missing date, or a series without days, is a miss with nothing near it.

    Requests meet the dates of their own year only, an array of at most 366; what is near
    in other years comes as borrowed ends on the year rows.  So no task holds a series,
    however long it is, and no request is compared with more dates than a year has.
    """
    if nearest < 1:
        raise ValueError("nearest must be at least 1")
    wanted = with_year(requested.select(*keys, DATE).distinct())
    offered = daily.select(*keys, DATE)
    if keys:
        offered = offered.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    years = year_rows(offered, nearest, keys)
    # Years that are only asked for take the ends of the years around them.
    asked = wanted.filter(F.col(YEAR).isNotNull()).select(*keys, YEAR).distinct()
    both = years.unionByName(asked.withColumn("dates", F.array().cast("array<date>")), allowMissingColumns=True)
    merged = both.groupBy(*keys, YEAR).agg(
        F.max_by("dates", F.size("dates")).alias("dates"), F.max("tail").alias("tail"), F.max("head").alias("head")
    )
    series = W.partitionBy(*keys).orderBy(YEAR)
    earlier, later = series.rowsBetween(W.unboundedPreceding, -1), series.rowsBetween(1, W.unboundedFollowing)
    around = merged.select(
        *[F.col(key).alias(f"_at_{key}") for key in keys],
        F.col(YEAR).alias("_at_year"),
        "dates",
        F.last("tail", ignorenulls=True).over(earlier).alias("tail"),
        F.first("head", ignorenulls=True).over(later).alias("head"),
    )
    same = [F.col(key) == F.col(f"_at_{key}") for key in keys] + [F.col(YEAR) == F.col("_at_year")]
    none = F.array().cast("array<date>")
    low = F.concat(F.coalesce("tail", none), F.coalesce(F.filter("dates", lambda day: day < F.col(DATE)), none))
    high = F.concat(F.coalesce(F.filter("dates", lambda day: day > F.col(DATE)), none), F.coalesce("head", none))
    found = F.coalesce(F.array_contains("dates", F.col(DATE)), F.lit(False))
    return wanted.join(around, same, "left").select(
        *keys,
        DATE,
        found.alias("found"),
        F.when(~found, last_of(low, nearest)).alias("dates_before"),
        F.when(~found, F.slice(high, 1, nearest)).alias("dates_after"),
    )


def demand_series(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Demand of the real days in date order with its position in the series, counted from 1."""
    rows = daily.filter(~is_projected()).select(*keys, DATE, DEMAND)
    return running_total(rows, keys, F.lit(1).cast("bigint"), "position")
