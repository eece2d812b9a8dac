"""Ordered computation over long series without one task per series.

A window over ``partitionBy(keys)`` puts a whole series into one task, and with no
keys the whole table.  Here a series is cut into calendar years: a year of a daily
series is at most 366 rows.  Each year is summed first (with map-side combine), the
years of a series are put in order (one small row per series and year), and the
detail rows only ever meet inside their own ``(keys, year)`` group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from dayplan.schema import DATE, Keys
from dayplan.sources.staging import stage

YEAR = "_year"
_BEFORE = "_before"
_TOTAL = "_total"


def with_year(rows: DataFrame) -> DataFrame:
    """The first day of the year as a column; rows that have it already are left alone."""
    return rows if YEAR in rows.columns else rows.withColumn(YEAR, F.trunc(DATE, "year"))


def running_total(
    rows: DataFrame,
    keys: Keys,
    value: Column,
    into: str,
    opening: DataFrame | None = None,
    addends: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over each series up to and including each date.

    ``opening`` optionally gives a starting balance as ``(keys..., opening)``.  It
    enters as one more addend dated before everything else, so no join is needed.
    ``addends`` as ``(keys..., date, amount)`` may stand in for ``value`` in the yearly
    sums, where the same sums can be had without the shuffle that made ``rows``.
    """
    cut = with_year(rows)
    if addends is None:
        totals = cut.groupBy(*keys, YEAR).agg(F.sum(value).alias(_TOTAL))
    else:
        totals = with_year(addends).groupBy(*keys, YEAR).agg(F.sum("amount").alias(_TOTAL))
    if opening is not None:
        first = F.lit("0001-01-01").cast("date").alias(YEAR)
        totals = totals.unionByName(
            opening.select(*keys, first, F.col("opening").cast("bigint").alias(_TOTAL))
        )
    earlier = W.partitionBy(*keys).orderBy(YEAR).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, YEAR, F.coalesce(F.sum(_TOTAL).over(earlier), F.lit(0)).alias(_BEFORE)
    )
    inside = (
        W.partitionBy(*keys, YEAR).orderBy(DATE).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # A left join keeps a row whose key is NULL, so that it can be reported.
    before = F.coalesce(
        F.col(_BEFORE), F.raise_error(F.lit("a series key or date is NULL")).cast("bigint")
    )
    return (
        cut.withColumn(into, F.sum(value).over(inside))
        .join(offsets, [*keys, YEAR], "left")
        .withColumn(into, (F.col(into) + before).cast("bigint"))
        .select(*[name for name in dict.fromkeys([*rows.columns, into]) if name != YEAR])
    )


def side_by_side(rows: DataFrame, marks: DataFrame, keys: Keys) -> tuple[DataFrame, WindowSpec]:
    """``rows`` and ``marks`` together by series and year, in one shuffle.

    Both are unique on ``(keys..., date)``.  In the order of the returned window the
    mark of a day comes just before its row, and what is computed per year afterwards
    finds the rows already in place and sorted.
    """
    both = rows.withColumn("_mark", F.lit(False)).unionByName(
        marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True
    )
    order = W.partitionBy(*keys, YEAR).orderBy(DATE, F.desc("_mark"))
    return with_year(both).repartition(*keys, YEAR), order


def follows_mark(order: WindowSpec) -> Column:
    """Whether a row has a mark for its day."""
    return (F.lag(DATE).over(order) == F.col(DATE)) & F.lag("_mark").over(order)


def overlay(rows: DataFrame, marks: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with the other columns of ``marks`` for the same day; marks without a row
    fall away."""
    extra = [name for name in marks.columns if name not in [*keys, DATE]]
    placed, order = side_by_side(rows, marks, keys)
    shown = [F.when(follows_mark(order), F.lag(name).over(order)).alias(name) for name in extra]
    return placed.select(*rows.columns, YEAR, "_mark", *shown).filter(~F.col("_mark")).drop("_mark")


def replace_days(rows: DataFrame, marks: DataFrame, keys: Keys) -> DataFrame:
    """``rows`` with the days in ``marks`` replaced or added; both have the same columns."""
    placed, order = side_by_side(rows, marks, keys)
    replaced = F.coalesce(follows_mark(order), F.lit(False)) & ~F.col("_mark")
    return placed.withColumn("_replaced", replaced).filter(~F.col("_replaced")).drop("_mark", "_replaced")


def running_total_by_series(
    rows: DataFrame, keys: Keys, value: Column, into: str, opening: DataFrame | None = None
) -> DataFrame:
    """The same numbers by one window per series: fewer steps, but one task per series.

    Only for tables with many short series; ``running_total`` is the safe form.
    """
    order = W.partitionBy(*keys).orderBy(DATE).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn(into, F.sum(value).over(order).cast("bigint"))
    if opening is None:
        return out
    start = F.coalesce(F.col("opening"), F.lit(0))
    if keys:
        out = out.join(opening, list(keys), "left")
    else:
        start = F.coalesce(opening.select("opening").scalar(), F.lit(0))
    return out.withColumn(into, F.col(into) + start).select(*dict.fromkeys([*rows.columns, into]))


def number_rows(
    rows: DataFrame, order: Sequence[str], into: str = "id", after: Column | None = None
) -> DataFrame:
    """Consecutive numbers 1, 2, ... in the order of ``order``, which must be unique.

    The rows are range-partitioned and sorted, written once so that their places
    stay fixed, and numbered by place plus the rows in earlier partitions.  Only
    the partition sizes (one row per partition) are ordered in one task, and only
    they are broadcast.
    """
    slot, part, place = "_slot", "_part", "_place"
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(slot, F.monotonically_increasing_id())
    )
    kept = (
        stage(placed, "ordered")
        .withColumn(part, F.shiftright(slot, 33))
        .withColumn(place, F.col(slot).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = kept.groupBy(part).agg(F.count("*").alias(_TOTAL))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(_TOTAL).over(earlier), F.lit(0)).alias(_BEFORE))
    base = F.lit(0) if after is None else after
    number = (F.col(_BEFORE) + F.col(place) + 1 + base).cast("bigint")
    return (
        kept.join(F.broadcast(starts), part)
        .withColumn(into, number)
        .select(into, *[name for name in rows.columns if name != into])
    )
