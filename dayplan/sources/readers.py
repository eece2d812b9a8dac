"""Any table that holds daily planning rows, in the form the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dayplan.functions.dates import normalize_date
from dayplan.schema import DAILY_COLUMNS, DATE, DEMAND, FORECAST, INVENTORY, PLAN, Keys


def as_daily(
    rows: DataFrame, keys: Keys = (), names: dict[str, str] | None = None, as_of=None
) -> DataFrame:
    """``rows`` from any Spark reader with the daily columns and types.

    ``names`` maps daily columns to the columns of ``rows`` where they differ.  A date
    held as text may have any accepted form, and one that has none becomes NULL; a
    missing forecast column is added as NULL.
    """
    source = {name: (names or {}).get(name, name) for name in DAILY_COLUMNS}
    date = F.col(source[DATE])
    if isinstance(rows.schema[source[DATE]].dataType, StringType):
        date = normalize_date(date, as_of)
    numbers = [
        (F.col(source[name]) if source[name] in rows.columns or name != FORECAST else F.lit(None))
        .cast("bigint")
        .alias(name)
        for name in (DEMAND, PLAN, FORECAST, INVENTORY)
    ]
    return rows.select(*keys, date.cast("date").alias(DATE), *numbers)


def broken_keys(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Series and dates that break the primary key: NULL, or held more than once."""
    missing = F.lit(False)
    for name in [*keys, DATE]:
        missing |= F.col(name).isNull()
    counted = daily.groupBy(*keys, DATE).agg(F.count("*").alias("rows"))
    return counted.filter((F.col("rows") > 1) | missing)
