"""Demand forecasts per series: moving average and exponential smoothing.

Both go by the place of a point in its series, never by the calendar.  A moving average
needs only the last points, which Spark can pick out before the shuffle.  Smoothing
reads everything: each year of a series (at most 366 points) becomes one small row, and
the years are then weighed by the counts before and after them.  So it costs one shuffle
of the demand and one of the year rows, whatever the length of a series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.functions.numbers import half_even, half_even_scaled, stored_whole
from dayplan.operators.edits import set_forecast
from dayplan.operators.running import YEAR, with_year
from dayplan.schema import (
    DAILY_COLUMNS,
    DATE,
    DEMAND,
    FORECAST,
    INVENTORY,
    PLAN,
    Keys,
    date_value,
    is_projected,
)
from dayplan.sources.staging import stage

# Fixed value: the smoothing level starts from a straight line through this many points.
START_POINTS = 10
LONGEST_YEAR = 366

Day = str | dt.date | Column


def history_of(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Demand of the real days; tables of demand alone hold nothing else."""
    if {DEMAND, PLAN, INVENTORY} <= set(daily.columns):
        daily = daily.filter(~is_projected())
    return daily.select(*keys, DATE, DEMAND)


def ordered_points() -> Column:
    """Demands of a group in date order."""
    points = F.array_sort(F.collect_list(F.struct(DATE, DEMAND)))
    return F.transform(points, lambda point: point[DEMAND].cast("double"))


def year_levels(daily: DataFrame, alpha: float, keys: Keys) -> DataFrame:
    """One small row per series and year.

    ``gain`` is the level the year's points give to a start of zero, ``head`` its first
    points, ``before`` and ``after`` count the points of the other years.
    """
    fade = F.lit(1.0 - alpha)
    gain = F.aggregate(
        "points", F.lit(0.0), lambda level, value: level * fade + value * F.lit(float(alpha))
    )
    years = (
        with_year(history_of(daily, keys))
        .groupBy(*keys, YEAR)
        .agg(
            ordered_points().alias("points"),
            F.count("*").alias("size"),
            F.count_if(F.col(DEMAND).isNull()).alias("gaps"),
            F.max(DATE).alias("last_date"),
        )
        .withColumn("gain", gain)
        .withColumn("head", F.slice("points", 1, START_POINTS))
        .drop("points")
    )
    series = W.partitionBy(*keys)
    earlier = series.orderBy(YEAR).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    after = F.sum("size").over(series) - F.col("before") - F.col("size")
    return years.withColumn("before", before).withColumn("after", after)


def add_up(values: Column, term=lambda value: value) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + term(value))


def last_rows(rows: DataFrame, count: int, group: Keys) -> DataFrame:
    """The last ``count`` rows by date of each group.

    For limits up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark drops the
    other rows before the shuffle.
    """
    newest = W.partitionBy(*group).orderBy(F.desc(DATE))
    numbered = rows.withColumn("_back", F.row_number().over(newest))
    return numbered.filter(F.col("_back") <= count).drop("_back")


def closing_years(rows: DataFrame, count: int, keys: Keys) -> DataFrame:
    """Rows of the last years of each series, as many years as hold its last ``count`` rows."""
    dated = with_year(rows)
    sizes = dated.groupBy(*keys, YEAR).agg(F.count("*").alias("size"))
    later = W.partitionBy(*keys).orderBy(F.desc(YEAR)).rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.sum("size").over(later), F.lit(0))
    wanted = sizes.withColumn("_after", after).filter(F.col("_after") < count)
    return dated.join(wanted.select(*keys, YEAR), [*keys, YEAR], "left_semi").drop(YEAR)


def moving_average_level(daily: DataFrame, window: int = 3, keys: Keys = ()) -> DataFrame:
    """Mean of the last ``window`` demands, or of all of a shorter series.

    A missing demand among them gives no forecast.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = history_of(daily, keys)
    if window > LONGEST_YEAR:
        rows = closing_years(rows, window, keys)
    level = (
        last_rows(rows, window, keys)
        .groupBy(*keys)
        .agg(
            F.max(DATE).alias("last_date"),
            F.count("*").alias("points_used"),
            F.count(DEMAND).alias("known"),
            F.avg(DEMAND).alias("mean"),
        )
        .filter(F.col("points_used") > 0)
    )
    complete = F.col("known") == F.col("points_used")
    return level.select(
        *keys,
        "last_date",
        "points_used",
        F.when(complete, half_even_scaled(F.col("mean"))).alias(FORECAST),
        F.when(complete, "ok").otherwise("missing_demand").alias("status"),
    )


def smoothing_level(daily: DataFrame, alpha: float = 0.5, keys: Keys = ()) -> DataFrame:
    """Level after ``l[t] = alpha*y[t] + (1-alpha)*l[t-1]``, started from a fitted line.

    Smoothing is affine in its start, so a year turns a level ``l`` into
    ``(1-alpha)^size * l + gain``, and the gains of all years add up once each is
    faded by the points that follow it.  The start is the intercept of the least
    squares line through the first ten points at positions 1 to 10; shorter series
    get no forecast but a status.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    fade = 1.0 - alpha
    faded = F.when(F.lit(fade == 0.0), F.when(F.col("after") == 0, 1.0).otherwise(0.0)).otherwise(
        F.pow(F.lit(fade), F.col("after"))
    )
    room = F.greatest(F.lit(0), F.lit(START_POINTS) - F.col("before")).cast("int")
    placed = F.transform("head", lambda value, at: value * (F.col("before") + at + 1))
    parts = (
        year_levels(daily, alpha, keys)
        .withColumn("head", F.slice("head", F.lit(1), room))
        .groupBy(*keys)
        .agg(
            F.sum(F.col("gain") * faded).alias("gain"),
            F.sum(add_up(F.col("head"))).alias("sum_y"),
            F.sum(add_up(placed)).alias("sum_iy"),
            F.sum("size").cast("bigint").alias("points_used"),
            F.sum("gaps").alias("gaps"),
            F.max("last_date").alias("last_date"),
        )
        .filter(F.col("points_used") > 0)
    )
    middle = (START_POINTS + 1) / 2
    spread = START_POINTS * (START_POINTS**2 - 1) / 12
    slope = (F.col("sum_iy") - F.lit(middle) * F.col("sum_y")) / F.lit(spread)
    start = F.col("sum_y") / F.lit(float(START_POINTS)) - slope * F.lit(middle)
    level = F.col("gain") + F.pow(F.lit(fade), F.col("points_used")) * start
    status = (
        F.when(F.col("gaps") > 0, "missing_demand")
        .when(F.col("points_used") < START_POINTS, "insufficient_history")
        .otherwise("ok")
    )
    return parts.withColumn("status", status).select(
        *keys,
        "last_date",
        "points_used",
        F.when(F.col("status") == "ok", half_even(level)).alias(FORECAST),
        "status",
    )


def forecast_level(
    daily: DataFrame,
    method: str = "exponential_smoothing",
    alpha: float = 0.5,
    window: int = 3,
    keys: Keys = (),
) -> DataFrame:
    """Any method other than ``moving_average`` means smoothing."""
    if method == "moving_average":
        return moving_average_level(daily, window, keys)
    return smoothing_level(daily, alpha, keys)


def spread_periods(level: DataFrame, periods: int, keys: Keys = ()) -> DataFrame:
    """The same value for each of ``periods`` periods."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(max(periods, 1)).cast("bigint"))
    return level.filter(F.lit(periods > 0)).select(
        *keys, F.explode(numbers).alias("period"), FORECAST, "status"
    )


def moving_average_forecast(
    daily: DataFrame, window: int = 3, periods: int = 7, keys: Keys = ()
) -> DataFrame:
    return spread_periods(moving_average_level(daily, window, keys), periods, keys)


def ses_forecast(
    daily: DataFrame, alpha: float = 0.5, periods: int = 7, keys: Keys = ()
) -> DataFrame:
    return spread_periods(smoothing_level(daily, alpha, keys), periods, keys)


def history_until(
    daily: DataFrame,
    start: Day,
    keys: Keys = (),
    include_start: bool = True,
    as_of: Day | None = None,
) -> DataFrame:
    """Rows up to ``start``; a series that only begins later keeps its whole history.

    A start that is not a date leaves nothing.
    """
    cut = date_value(start, as_of)
    inside = F.col(DATE) <= cut if include_start else F.col(DATE) < cut
    rows = history_of(daily, keys)
    begins = rows.groupBy(*keys).agg(F.min(DATE).alias("_first"))
    if keys:
        # Written, so that its true size decides how it is joined.
        late = stage(begins.filter(F.col("_first") > cut).select(*keys), "late")
        whole = rows.filter(F.col(DATE) > cut).join(late, list(keys), "left_semi")
    else:
        whole = rows.filter((F.col(DATE) > cut) & (begins.scalar() > cut))
    return rows.filter(inside).unionByName(whole)


def forecast_from_date(
    daily: DataFrame,
    start: Day,
    periods: int = 7,
    method: str = "exponential_smoothing",
    alpha: float = 0.5,
    window: int = 3,
    keys: Keys = (),
    include_start: bool = True,
    as_of: Day | None = None,
) -> DataFrame:
    """Forecast from the history up to ``start``."""
    history = history_until(daily, start, keys, include_start, as_of)
    return spread_periods(forecast_level(history, method, alpha, window, keys), periods, keys)


def future_forecast_rows(
    daily: DataFrame,
    periods: int = 7,
    start: Day | None = None,
    method: str = "exponential_smoothing",
    alpha: float = 0.5,
    window: int = 3,
    keys: Keys = (),
    include_start: bool = True,
    as_of: Day | None = None,
) -> DataFrame:
    """Dated forecasts: from ``start``, or from the day after the last real one."""
    history = daily if start is None else history_until(daily, start, keys, include_start, as_of)
    level = forecast_level(history, method, alpha, window, keys)
    return dated_rows(level, periods, start, keys, as_of)


def dated_rows(
    level: DataFrame, periods: int, start: Day | None = None, keys: Keys = (), as_of: Day | None = None
) -> DataFrame:
    """One row per forecast day of each level."""
    first = F.date_add("last_date", 1) if start is None else date_value(start, as_of)
    dated = level.filter(F.lit(periods > 0)).withColumn("_first", first)
    days = F.sequence("_first", F.date_add("_first", max(periods, 1) - 1))
    return dated.select(*keys, F.explode(days).alias(DATE), FORECAST, "status")


def persist_forecast(
    daily: DataFrame, forecasts: DataFrame, keys: Keys = (), mode: str = "update"
) -> DataFrame:
    """Store dated forecasts as whole numbers.

    ``update`` only fills days the table already has.  ``upsert`` also adds the other
    days.  Those are projected days, without demand, plan or balance: no operator takes them
    for history, and the latest inventory stays that of the last real day.
    """
    if mode not in ("update", "upsert"):
        raise ValueError(f"mode must be 'update' or 'upsert', not {mode!r}")
    known = forecasts.filter(F.col(FORECAST).isNotNull()).select(
        *keys, DATE, stored_whole(F.col(FORECAST)).alias("value")
    )
    rows = daily.select(*keys, *DAILY_COLUMNS)
    updated = set_forecast(rows, known, keys)
    if mode == "update":
        return updated
    days = rows.select(*keys, DATE).join(known.select(*keys, DATE), [*keys, DATE])
    added = known.join(days, [*keys, DATE], "left_anti")
    nothing = F.lit(None).cast("bigint")
    return updated.unionByName(
        added.select(
            *keys,
            DATE,
            nothing.alias(DEMAND),
            nothing.alias(PLAN),
            F.col("value").alias(FORECAST),
            nothing.alias(INVENTORY),
        )
    )


def moving_average_series(daily: DataFrame, window: int = 3, keys: Keys = ()) -> DataFrame:
    """Rolling mean at every day; NULL until ``window`` days exist or where one is missing.

    The sum of a window is the difference of two running sums, that of the day and that of the
    day ``window`` places before.  Inside a year the earlier one is looked up in the year's own
    order.  A day too near to the beginning of its year finds it by its position in the
    series, in a join with the closing days of the years.  A row carries four numbers however
    wide the window is, and no task holds more than a year of a series.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = history_of(daily, keys)
    order = W.partitionBy(*keys, YEAR).orderBy(DATE)
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    year = W.partitionBy(*keys, YEAR)
    dated = with_year(rows)
    local = dated.select(
        "*",
        F.row_number().over(order).alias("_place"),
        F.count("*").over(year).alias("_size"),
        F.coalesce(F.sum(DEMAND).over(running), F.lit(0)).alias("_sum"),
        F.count(DEMAND).over(running).alias("_known"),
    ).select(
        "*",
        F.lag("_sum", window).over(order).alias("_sum_before"),
        F.lag("_known", window).over(order).alias("_known_before"),
    )
    years = dated.groupBy(*keys, YEAR).agg(
        F.count("*").alias("_n"), F.coalesce(F.sum(DEMAND), F.lit(0)).alias("_s"), F.count(DEMAND).alias("_k")
    )
    earlier = W.partitionBy(*keys).orderBy(YEAR).rowsBetween(W.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_all") for name in ("_n", "_s", "_k")]
    placed = local.join(years.select(*keys, YEAR, *before), [*keys, YEAR]).select(
        *keys, DATE, DEMAND, "_place", "_size", "_sum_before", "_known_before", "_sum", "_known",
        (F.col("_n_all") + F.col("_place")).alias("_position"),
        (F.col("_s_all") + F.col("_sum")).alias("_sum_all"),
        (F.col("_k_all") + F.col("_known")).alias("_known_all"),
    )
    inside = F.col("_place") > window
    first = F.col("_position") <= window  # nothing stands before the window
    done = placed.filter(inside | first)
    whole = F.when(inside, F.col("_known") - F.col("_known_before")).otherwise(F.col("_known_all")) == window
    total = F.when(inside, F.col("_sum") - F.col("_sum_before")).otherwise(F.col("_sum_all"))
    enough = whole & (F.col("_position") >= window)
    mean = lambda total: half_even_scaled(total / F.lit(window))
    own = done.select(*keys, DATE, DEMAND, F.when(enough, mean(total)).alias("moving_average"))
    across = placed.filter(~(inside | first)).select(
        *keys, DATE, DEMAND, (F.col("_position") - window).alias("_at"), "_sum_all", "_known_all"
    )
    closing = placed.filter(F.col("_size") - F.col("_place") < window).select(
        *[F.col(key).alias(f"_of_{key}") for key in keys],
        "_position",
        F.col("_sum_all").alias("_old_sum"),
        F.col("_known_all").alias("_old_known"),
    )
    same = [F.col(key) == F.col(f"_of_{key}") for key in keys] + [F.col("_at") == F.col("_position")]
    gap_free = F.col("_known_all") - F.col("_old_known") == window
    lent = across.join(closing, same, "left").select(
        *keys, DATE, DEMAND, F.when(gap_free, mean(F.col("_sum_all") - F.col("_old_sum"))).alias("moving_average")
    )
    return own.unionByName(lent)


def demand_forecast_series(
    daily: DataFrame, periods: int = 5, alpha: float = 0.5, keys: Keys = ()
) -> DataFrame:
    """History and forecast as the two labelled lines of one chart."""
    history = history_of(daily, keys).select(
        *keys,
        DATE,
        F.lit("Historical Demand").alias("series"),
        F.col(DEMAND).cast("double").alias("value"),
    )
    ahead = future_forecast_rows(daily, periods, alpha=alpha, keys=keys)
    ahead = ahead.filter(F.col(FORECAST).isNotNull())
    return history.unionByName(
        ahead.select(*keys, DATE, F.lit("Forecast").alias("series"), F.col(FORECAST).alias("value"))
    )
