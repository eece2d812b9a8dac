"""Edits of the daily table as joins: no row loop, no half-done state.

An edit list has ``(keys..., date, field, value, seq)``; the highest ``seq`` wins per
key, date and field.  Nothing here forces a broadcast: with few edits adaptive
execution broadcasts them and the daily rows are not shuffled, with many it
shuffles both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayplan.operators.inventory import net_flow, recalc_inventory, renumber, split_at
from dayplan.operators.running import overlay, replace_days
from dayplan.operators.scans import rows_in_range
from dayplan.schema import (
    DAILY_COLUMNS,
    DATE,
    DEMAND,
    EDITABLE,
    FORECAST,
    INVENTORY,
    PLAN,
    Keys,
    bigint,
    date_value,
    int_or_fail,
    is_projected,
    real_day,
)
from dayplan.sources.staging import stage

# Outcome texts.
NO_FORECAST_TEXT = "No forecast values found in the specified date range."
NO_OFFSET_TEXT = "Offset is zero; no changes made."
NO_DATA_TEXT = "No data available to update."
ALL_CLEARED_TEXT = "All forecast values cleared."
UNREADABLE_TEXT = "The date could not be read: {}"


def one_edit(
    spark: SparkSession,
    date: str | dt.date,
    field: str,
    value: int,
    series: dict | None = None,
    as_of: str | dt.date | None = None,
) -> DataFrame:
    """A list of one edit, for callers that change a single day."""
    named = [F.lit(held).alias(key) for key, held in (series or {}).items()]
    return spark.range(1).select(
        *named,
        date_value(date, as_of).alias(DATE),
        F.lit(field).alias("field"),
        F.lit(int(value)).cast("bigint").alias("value"),
        F.lit(1).cast("bigint").alias("seq"),
    )


def as_edits(changes: DataFrame, field: str) -> DataFrame:
    """``(keys..., date, value[, seq])`` rows as edits of one field."""
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(0).cast("bigint"))
    return changes.withColumn("field", F.lit(field))


def fold_edits(edits: DataFrame, keys: Keys = (), fields: Sequence[str] = EDITABLE) -> DataFrame:
    """One row per edited day, one ``_new_<field>`` column per field, last writer kept."""
    chosen = [
        F.max_by(
            int_or_fail(F.col("value"), "an edit value"),
            F.when(F.col("field") == field, F.col("seq")),
        ).alias(f"_new_{field}")
        for field in fields
    ]
    return edits.groupBy(*keys, DATE).agg(*chosen)


def write_fields(daily: DataFrame, folded: DataFrame, keys: Keys = ()) -> DataFrame:
    """Overwrite the edited fields; days that are not in the table change nothing."""
    fields = [field for field in EDITABLE if f"_new_{field}" in folded.columns]
    return overwrite(daily.join(folded, [*keys, DATE], "left"), fields).select(*daily.columns)


def overwrite(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Take the new value of a field where there is one; a projected day only takes forecasts."""
    fixed = is_projected() if INVENTORY in rows.columns else F.lit(False)
    new = {
        field: F.coalesce(F.when(F.lit(field == FORECAST) | ~fixed, F.col(f"_new_{field}")), field)
        for field in fields
        if field in rows.columns
    }
    return rows.withColumns(new).drop(*[f"_new_{field}" for field in fields])


def flow_amounts(rows: DataFrame, keys: Keys, sign: int = 1) -> DataFrame:
    """``(keys..., date, amount)``: what each row adds to the stock, missing numbers as zero."""
    return rows.select(*keys, DATE, (net_flow("zero") * sign).alias("amount"))


def apply_edits(
    daily: DataFrame,
    edits: DataFrame,
    keys: Keys = (),
    on_null: str = "error",
    fields: Sequence[str] = EDITABLE,
) -> DataFrame:
    """Write the edits, then recalculate each touched series from its first changed day.

    The edited days are joined with the table once, which tells where each series
    starts and by how much its yearly sums change.  The new values then reach their
    rows in the same shuffle that the recalculation needs.  Rows outside the
    recalculated part can only have a new forecast.
    """
    folded = stage(fold_edits(edits, keys, fields), "edits")
    moving = [f"_new_{field}" for field in (PLAN, DEMAND) if field in fields]
    moved = folded.filter(F.coalesce(*moving).isNotNull()).select(*keys, DATE, *moving)
    real = daily.filter(~is_projected())
    hits = real.select(*keys, DATE, DEMAND, PLAN).join(moved, [*keys, DATE])
    hits = stage(hits, "hits")
    starts = stage(hits.groupBy(*keys).agg(F.min(DATE).alias("start")), "starts")
    active, earlier, rest = split_at(daily, starts, keys)
    addends = (
        flow_amounts(active, keys)
        .unionByName(flow_amounts(hits, keys, -1))
        .unionByName(flow_amounts(overwrite(hits, fields), keys))
    )
    edited = overwrite(overlay(active, folded, keys), fields)
    if FORECAST in fields:
        forecasts = folded.select(*keys, DATE, f"_new_{FORECAST}")
        rest = write_fields(rest, forecasts.filter(F.col(f"_new_{FORECAST}").isNotNull()), keys)
    return renumber(edited, earlier, keys, on_null, addends=addends).unionByName(rest)


def set_production_plan(
    daily: DataFrame, changes: DataFrame, keys: Keys = (), on_null: str = "error"
) -> DataFrame:
    return apply_edits(daily, as_edits(changes, PLAN), keys, on_null, [PLAN])


def set_demand(
    daily: DataFrame, changes: DataFrame, keys: Keys = (), on_null: str = "error"
) -> DataFrame:
    return apply_edits(daily, as_edits(changes, DEMAND), keys, on_null, [DEMAND])


def set_forecast(daily: DataFrame, changes: DataFrame, keys: Keys = ()) -> DataFrame:
    """Forecasts do not move the stock, so there is nothing to recalculate."""
    return write_fields(daily, fold_edits(as_edits(changes, FORECAST), keys, [FORECAST]), keys)


def edit_report(daily: DataFrame, edits: DataFrame, keys: Keys = ()) -> DataFrame:
    """Each edit with its outcome: ``updated``, ``not_found``, or ``invalid_date`` for one
    without a date, such as from a text that could not be read.

    A projected day has no demand and no plan to edit, only its forecast.
    """
    days = edits.select(*keys, DATE).distinct()
    held = daily.select(*keys, DATE, (~is_projected()).alias("_real"))
    hits = held.join(days, [*keys, DATE]).withColumn("_hit", F.lit(True))
    # Written, so that the join below can split a day with very many edits.
    hits = stage(hits, "hits")
    missing = F.concat(F.lit("No record found for date "), F.col(DATE).cast("string"), F.lit("."))
    done = F.coalesce(F.col("_hit") & (F.col("_real") | (F.col("field") == FORECAST)), F.lit(False))
    return edits.join(hits, [*keys, DATE], "left").select(
        *keys,
        DATE,
        "field",
        "value",
        "seq",
        F.when(done, "updated").when(F.col(DATE).isNull(), "invalid_date").otherwise("not_found").alias("outcome"),
        F.when(~done, F.coalesce(missing, F.lit(UNREADABLE_TEXT.format("NULL")))).alias("message"),
    )


def shift_demand(
    daily: DataFrame, offset: int, keys: Keys = (), on_null: str = "error"
) -> DataFrame:
    """Add ``offset`` to every demand and recalculate from the first day; 0 changes nothing."""
    if offset == 0:
        return daily
    moved = int_or_fail(F.col(DEMAND), DEMAND, on_null) + F.lit(int(offset)).cast("bigint")
    moved = F.when(~is_projected(), moved)
    return recalc_inventory(daily.withColumn(DEMAND, moved), None, keys, on_null)


def shift_outcome(daily: DataFrame, offset: int) -> DataFrame:
    """What shifting all demand amounts to: one row with the days changed and a message."""
    days = daily.agg(bigint(F.count_if(~is_projected())).alias("days"))
    changed = F.when(F.lit(offset != 0), F.col("days")).otherwise(F.lit(0).cast("bigint"))
    done = F.format_string(
        f"Demand increased by {int(offset)} units for %d days. Inventory recalculated cumulatively.", "days"
    )
    text = F.when(F.lit(offset == 0), NO_OFFSET_TEXT).when(F.col("days") == 0, NO_DATA_TEXT).otherwise(done)
    return days.select(changed.alias("changed"), text.alias("message"))


def clear_all_outcome(daily: DataFrame) -> DataFrame:
    """What clearing all forecasts amounts to: one row with the forecasts cleared and a message."""
    cleared = daily.agg(bigint(F.count(FORECAST)).alias("cleared"))
    return cleared.withColumn("message", F.lit(ALL_CLEARED_TEXT))


def clear_all_forecast(daily: DataFrame) -> DataFrame:
    return daily.withColumn(FORECAST, F.lit(None).cast(daily.schema[FORECAST].dataType))


def clear_forecast_range(
    daily: DataFrame,
    start: str | dt.date | Column,
    end: str | dt.date | Column | None = None,
    as_of: str | dt.date | None = None,
) -> DataFrame:
    """Forecast NULL from ``start`` to ``end``, both included; no ``end`` means to the last day."""
    inside = F.col(DATE) >= date_value(start, as_of)
    if end is not None:
        inside &= F.col(DATE) <= date_value(end, as_of)
    kept = F.when(inside, F.lit(None)).otherwise(F.col(FORECAST))
    return daily.withColumn(FORECAST, kept.cast(daily.schema[FORECAST].dataType))


def clear_forecast_outcome(
    daily: DataFrame,
    start: str | dt.date | Column,
    end: str | dt.date | Column | None = None,
    as_of: str | dt.date | None = None,
) -> DataFrame:
    """What clearing the range amounts to: one row with a status and a message."""
    first = date_value(start, as_of)
    last = F.lit(None).cast("date") if end is None else date_value(end, as_of)
    done = F.concat(
        F.lit("Forecast cleared "),
        F.when(last.isNull(), F.concat(F.lit("on or after "), first.cast("string"))).otherwise(
            F.concat(F.lit("from "), first.cast("string"), F.lit(" to "), last.cast("string"))
        ),
        F.lit("."),
    )
    held = rows_in_range(daily, start, end, as_of).agg(bigint(F.count(FORECAST)).alias("cleared"))
    return held.select(
        "cleared",
        F.when(F.col("cleared") > 0, "cleared").otherwise("no_forecast").alias("outcome"),
        F.when(F.col("cleared") > 0, done).otherwise(NO_FORECAST_TEXT).alias("message"),
    )


def one_per_day(changes: DataFrame, keys: Keys = ()) -> DataFrame:
    """One change per key and day: the last by ``seq``; without that column repeats are an error."""
    days = [*keys, DATE]
    names = [name for name in changes.columns if name not in [*days, "seq"]]
    if "seq" in changes.columns:
        last = changes.groupBy(*days).agg(F.max(F.struct("seq", *names)).alias("_last"))
        return last.select(*days, *[F.col(f"_last.{name}").alias(name) for name in names])
    counted = changes.groupBy(*days).agg(F.count("*").alias("_n"), *[F.first(name).alias(name) for name in names])
    repeated = F.raise_error(F.lit("several changes for one day and no seq to order them")).cast("boolean")
    return counted.filter(F.when(F.col("_n") == 1, True).otherwise(repeated)).select(*days, *names)


def upsert_daily(
    daily: DataFrame,
    changes: DataFrame,
    keys: Keys = (),
    recalc_tail: bool = True,
    on_null: str = "error",
) -> DataFrame:
    """Overwrite or add whole days, unique on ``(keys..., date)``, and renumber inventory.

    Of several changes for a day the one with the largest ``seq`` counts; without that
    column they are an error.  Without a forecast column existing forecasts are kept.  With
    ``recalc_tail=False`` only the written days get a new inventory, and later days
    keep a balance that no longer follows from them.
    """
    columns = [*keys, *DAILY_COLUMNS]
    rows = daily.select(*columns)
    written = stage(one_per_day(changes, keys), "upsert")
    days = written.select(*keys, DATE)
    held = stage(rows.drop(INVENTORY).join(days, [*keys, DATE]), "held")
    if FORECAST not in written.columns:
        written = written.join(held.select(*keys, DATE, FORECAST), [*keys, DATE], "left")
    written = written.withColumn(INVENTORY, F.lit(None).cast("bigint")).select(*columns)
    starts = stage(days.groupBy(*keys).agg(F.min(DATE).alias("start")), "starts")
    active, earlier, rest = split_at(rows, starts, keys)
    if not recalc_tail:
        kept = rows.join(held.select(*keys, DATE), [*keys, DATE], "left_anti")
        return renumber(written, earlier, keys, on_null).unionByName(kept)
    addends = (
        flow_amounts(active, keys)
        .unionByName(flow_amounts(held, keys, -1))
        .unionByName(flow_amounts(written, keys))
    )
    full = replace_days(active, written, keys)
    return renumber(full, earlier, keys, on_null, addends=addends).unionByName(rest)


def extend_calendar(
    daily: DataFrame,
    days: int,
    start: str | dt.date | Column | None = None,
    keys: Keys = (),
    as_of: str | dt.date | None = None,
) -> DataFrame:
    """``days`` consecutive dates per series, from ``start`` or the day after its last real one."""
    ends = daily.groupBy(*keys).agg(F.max(real_day()).alias("_last"))
    first = F.date_add("_last", 1) if start is None else date_value(start, as_of)
    spine = ends.withColumn("_first", first).filter(F.col("_first").isNotNull())
    last = F.date_add("_first", days - 1)
    return spine.filter(F.lit(days > 0)).select(
        *keys, F.explode(F.sequence("_first", last)).alias(DATE)
    )


def delete_all_daily(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without rows, and a one-row report of the counts before and after."""
    empty = daily.filter(F.lit(False))
    report = daily.agg(bigint(F.count("*")).alias("rows_removed")).select(
        "rows_removed", F.lit(0).cast("bigint").alias("rows_left")
    )
    return empty, report


def ensure_column(table: DataFrame, name: str, type_name: str, default=None) -> DataFrame:
    """Add a column that is missing; one that exists is left as it is."""
    if name in table.columns:
        return table
    return table.withColumn(name, F.lit(default).cast(type_name))


