"""Text dates of an old table, rewritten in place as ISO text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayplan.functions.dates import iso_text, normalize_date

# The two accepted layouts of a stored date.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
DAY_FIRST_SHAPE = r"^\d{1,2}-\d{1,2}-\d{4}$"


def migrate_date_format(table: DataFrame, column: str = "date_text") -> DataFrame:
    """``DD-MM-YYYY`` to ``YYYY-MM-DD``; ISO text and text that is no date stay as they are.

    ``column`` is the primary key.  A conversion that would hit a date already stored
    stays undone; of several that would give the same date the smallest text is taken.
    """
    text = F.col(column)
    is_iso = text.rlike(ISO_SHAPE) & F.try_to_date(text, "yyyy-M-d").isNotNull()
    target = F.when(
        ~is_iso & text.rlike(DAY_FIRST_SHAPE), iso_text(F.try_to_date(text, "d-M-yyyy"))
    )
    # Every row lays claim to its own text and, if it is to change, to its new one.
    own = F.struct(text.alias("_to"), F.lit(None).cast("string").alias("_from"))
    new = F.struct(target.alias("_to"), text.alias("_from"))
    claims = table.select(F.inline(F.array(own, new))).filter(F.col("_to").isNotNull())
    winners = claims.groupBy("_to").agg(
        F.min("_from").alias("_from"), F.count_if(F.col("_from").isNull()).alias("_stored")
    )
    changed = winners.filter(F.col("_stored") == 0).select(
        F.col("_from").alias(column), F.col("_to").alias("_won")
    )
    return (
        table.join(changed, column, "left")
        .withColumn(column, F.coalesce("_won", column))
        .select(*table.columns)
    )


def normalize_date_column(table: DataFrame, column: str, into: str = "date", as_of=None) -> DataFrame:
    """Adds the DATE meant by a text column; NULL where it is not a date."""
    return table.withColumn(into, normalize_date(F.col(column), as_of))
