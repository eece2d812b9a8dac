"""Column names, schemas and small helpers shared by every operator.

The daily table holds one row per series and day.  ``keys`` is the list of
columns that name a series; an empty list means the table is one series.
``(keys..., date)`` is the primary key: unique, and never NULL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "date"
DEMAND = "demand"
PLAN = "production_plan"
FORECAST = "forecast"
INVENTORY = "inventory"
DAILY_COLUMNS = [DATE, DEMAND, PLAN, FORECAST, INVENTORY]
EDITABLE = [PLAN, DEMAND, FORECAST]

Keys = Sequence[str]


def daily_schema(key_fields: Sequence[T.StructField] = ()) -> T.StructType:
    return T.StructType(
        [
            *key_fields,
            T.StructField(DATE, T.DateType(), False),
            T.StructField(DEMAND, T.LongType()),
            T.StructField(PLAN, T.LongType()),
            T.StructField(FORECAST, T.LongType()),
            T.StructField(INVENTORY, T.LongType()),
        ]
    )


MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

USER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)


def is_projected() -> Column:
    """A day that holds nothing but a stored forecast: beyond the horizon of the history.

    Such days have no balance and take no part in history, summaries or "latest" until
    they get a demand and a plan.
    """
    return F.col(DEMAND).isNull() & F.col(PLAN).isNull() & F.col(INVENTORY).isNull()


def real_day() -> Column:
    """The date of a real day, NULL on a projected one."""
    return F.when(~is_projected(), F.col(DATE))


def bigint(column: Column) -> Column:
    return column.cast(T.LongType())


def int_or_fail(column: Column, what: str, on_null: str = "error") -> Column:
    """A whole number, with NULL either failing the job or counting as zero.

    Spark's ``sum`` would skip a NULL without a word, so the choice is made in
    the expression itself and needs no validating pass beforehand.
    """
    if on_null == "zero":
        return F.coalesce(bigint(column), F.lit(0).cast("bigint"))
    if on_null != "error":
        raise ValueError(f"on_null must be 'error' or 'zero', not {on_null!r}")
    return F.coalesce(
        bigint(column), bigint(F.raise_error(F.lit(f"{what} is NULL where a number is needed")))
    )


def date_value(value: str | dt.date | Column, as_of: str | dt.date | None = None) -> Column:
    """A date argument as a column: a date, text in any accepted form, or a column.

    Text is parsed by a foldable expression, so Catalyst turns it into a literal
    before planning and a comparison with it still reaches the Parquet scan.
    """
    from dayplan.functions.dates import normalize_date

    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        return F.lit(value)
    return normalize_date(F.lit(value), as_of)
