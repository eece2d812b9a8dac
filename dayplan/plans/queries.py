"""Named queries over the given tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayplan.functions.dates import normalize_date
from dayplan.operators import conversations as talk
from dayplan.operators import edits as ed
from dayplan.operators import forecast as fc
from dayplan.operators import inventory as inv
from dayplan.operators import migrate, scans, summary, users
from dayplan.plans.forecast_to_plan import forecast_to_plan
from dayplan.schema import DATE, DEMAND, FORECAST, INVENTORY, PLAN
from dayplan.sources import views
from dayplan.sources.balances import BalanceTable
from dayplan.sources.buckets import BucketedTable
from dayplan.sources.staging import new_path
from dayplan.sources.tables import StoredTable, publish_snapshot
from dayplan.streaming import events as ev
from dayplan.streaming.edits import stream_apply_edits, write_edits

Query = Callable[[SparkSession, str], DataFrame]

KEYS = [views.SERIES]
START = "01-06-1997"
AS_OF = "2024-06-15"


def on_daily(operator: Callable[[DataFrame], DataFrame], by: str | None = "brand") -> Query:
    return lambda spark, sf_dir: operator(views.daily(spark, sf_dir, by))


def on_stale(operator: Callable[[DataFrame], DataFrame], by: str | None = "brand") -> Query:
    return lambda spark, sf_dir: operator(views.daily_stale(spark, sf_dir, by))


def on_log(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(views.conversation_history(spark, sf_dir))


def edits_of(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return views.edits(spark, sf_dir).filter(F.col("field") == field)


def nearest_dates(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    """Every first of a month of a series, moved on by five years, and one day of 1980."""
    keys = [] if by is None else KEYS
    rows = views.daily(spark, sf_dir, by)
    months = rows.select(*keys, F.add_months(F.trunc(DATE, "month"), 60).alias(DATE))
    early = rows.select(*keys, F.lit("1980-06-15").cast("date").alias(DATE))
    found = scans.lookup_available_dates(rows, months.unionByName(early), keys, 4)
    listed = [
        F.array_join(F.transform(name, lambda day: day.cast("string")), ",").alias(name)
        for name in ("dates_before", "dates_after")
    ]
    return found.select(*keys, DATE, "found", *listed)


def without_forecast(daily: DataFrame) -> DataFrame:
    return ed.ensure_column(daily.drop(FORECAST), FORECAST, "bigint", 0)


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    batch = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.lit("assistant").alias("role"),
        F.col("props").alias("content"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )
    log = views.conversation_history(spark, sf_dir)
    return talk.append_messages(log, batch, ["timestamp", "event_id"])


def cleared_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.conversation_history(spark, sf_dir)
    anonymous = log.filter(F.col("user_id").isNull()).select("session_id")
    return talk.clear_session(log, anonymous)


def text_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.users_int(spark, sf_dir).withColumn("id", F.col("id").cast("string"))


def renamed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are shown by their market segment."""
    owing = views.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0)
    changes = owing.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("display_name")
    )
    return users.set_display_name(text_users(spark, sf_dir), changes)


def projected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit list, and demand and forecast edits of projected days."""
    ends = views.daily(spark, sf_dir).groupBy(*KEYS).agg(F.max(DATE).alias("last"))
    ahead = ends.select(
        *KEYS,
        F.date_add("last", 3).alias(DATE),
        F.explode(F.array(F.lit(DEMAND), F.lit(FORECAST))).alias("field"),
        F.lit(77).cast("bigint").alias("value"),
        F.lit(5).cast("bigint").alias("seq"),
    )
    return views.edits(spark, sf_dir).unionByName(ahead)


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = StoredTable(spark, new_path(spark, "log"))
    return talk.create_log(table, views.conversation_history(spark, sf_dir)).read()


def staged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.agent_events(spark, sf_dir)
    early = F.col("kind").isin("raw_response", "tool_called")
    late = events.filter(~early)
    columns = ["session_id", "stage", "seq", "kind", "name"]
    return ev.two_stage_events(events.filter(early), late.unionByName(late)).select(*columns)


def streamed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = views.agent_event_stream(spark, sf_dir)
    sink, checkpoint = new_path(spark, "debug-messages"), new_path(spark, "debug-checkpoint")
    return ev.collect_events(stream, sink, checkpoint).drop("batch")


def streamed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of all numbers arrive as files and are applied in batches."""
    folder = new_path(spark, "edit-stream")
    arriving = views.edits(spark, sf_dir)
    arriving.write.parquet(folder)
    table = StoredTable(spark, new_path(spark, "edited-daily"))
    table.create(views.daily_stale(spark, sf_dir), layout="series", keys=KEYS, parts=16)
    stream = spark.readStream.schema(arriving.schema).parquet(folder)
    return stream_apply_edits(stream, table, new_path(spark, "edit-checkpoint"), KEYS)


def edited_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table stored by month after an edit of its last years."""
    table = StoredTable(spark, new_path(spark, "daily-by-month"))
    table.create(views.daily_stale(spark, sf_dir))
    late = views.edits(spark, sf_dir).filter(F.col(DATE) >= F.lit("1999-03-01").cast("date"))
    write_edits(table, late, KEYS)
    return table.read()


def balances(spark: SparkSession, sf_dir: str) -> BalanceTable:
    """The table with wrong balances, stored by year."""
    return BalanceTable(spark, new_path(spark, "balances"), KEYS).create(views.daily_stale(spark, sf_dir))


def recalculated_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = balances(spark, sf_dir)
    table.recalc_inventory(START)
    return table.read()


def edited_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edit lists after each other, the later days first."""
    table = balances(spark, sf_dir)
    late = F.coalesce(F.col(DATE) >= F.lit("1999-03-01").cast("date"), F.lit(True))
    edits = views.edits(spark, sf_dir)
    table.apply_edits(edits.filter(late))
    table.apply_edits(edits.filter(~late))
    return table.read()


def set_forecast_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edit lists, one after the other, on the daily table in buckets."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = BucketedTable(spark, f"daily_{uuid.uuid4().hex[:12]}", new_path(spark, "buckets"), KEYS, buckets)
    table.create(views.daily(spark, sf_dir))
    for part in ("seq < 3", "seq >= 3"):
        table.set_forecast(views.edits(spark, sf_dir).filter(part))
    return table.read()


QUERIES: dict[str, Query] = {
    # scans, sources, sinks
    "scan_daily": on_daily(lambda d: scans.scan_daily(d, KEYS)),
    "lookup_daily": on_daily(lambda d: scans.lookup_daily(d, "June 1996", KEYS)),
    "lookup_available_dates": lambda spark, sf_dir: nearest_dates(spark, sf_dir, "brand"),
    "lookup_available_dates_single": lambda spark, sf_dir: nearest_dates(spark, sf_dir, None),
    "publish_snapshot": lambda spark, sf_dir: publish_snapshot(
        views.daily(spark, sf_dir), new_path(spark, "published")
    ),
    "publish_edits_by_month": edited_by_month,
    "append_messages": appended,
    "ensure_column": on_daily(without_forecast),
    # projections, filters
    "demand_series": on_daily(lambda d: scans.demand_series(d, KEYS)),
    "rows_in_range": on_daily(lambda d: scans.rows_in_range(d, START, "31/12/1999")),
    "forecast_rows_in_range": on_daily(
        lambda d: scans.forecast_rows_in_range(d, START, "31/12/1999", KEYS)
    ),
    "stockouts": on_daily(lambda d: inv.stockouts(d, KEYS)),
    "stockout_proposals": on_daily(lambda d: inv.stockout_proposals(d, KEYS)),
    "stockout_backlog_proposals": on_daily(
        lambda d: inv.stockout_proposals(d, KEYS, cover_backlog=True)
    ),
    "agent_context": lambda spark, sf_dir: talk.agent_context(views.log_with_debug(spark, sf_dir)),
    # summaries
    "production_summary": on_daily(lambda d: summary.production_summary(d, KEYS)),
    "demand_summary": on_daily(lambda d: summary.demand_summary(d, KEYS)),
    "inventory_summary": on_daily(lambda d: summary.inventory_summary(d, KEYS)),
    "inventory_summary_single": on_daily(summary.inventory_summary, None),
    "latest_inventory": on_daily(lambda d: summary.latest_inventory(d, KEYS)),
    "latest_inventory_single": on_daily(summary.latest_inventory, None),
    "kpi_cards": on_daily(lambda d: summary.kpi_cards(d, KEYS)),
    "history_bounds": on_daily(lambda d: summary.history_bounds(d, KEYS)),
    "delete_all_daily": on_daily(lambda d: ed.delete_all_daily(d)[1]),
    # inventory
    "recalc_inventory": on_stale(lambda d: inv.recalc_inventory(d, START, KEYS)),
    "recalc_inventory_single": on_stale(lambda d: inv.recalc_inventory(d, START), None),
    "recalc_inventory_by_year": recalculated_by_year,
    "apply_edits_by_year": edited_by_year,
    "shift_demand": on_stale(lambda d: ed.shift_demand(d, 50, KEYS)),
    # edits
    "set_production_plan": lambda spark, sf_dir: ed.set_production_plan(
        views.daily_stale(spark, sf_dir), edits_of(spark, sf_dir, PLAN), KEYS
    ),
    "set_demand": lambda spark, sf_dir: ed.set_demand(
        views.daily_stale(spark, sf_dir), edits_of(spark, sf_dir, DEMAND), KEYS
    ),
    "apply_edits": lambda spark, sf_dir: ed.apply_edits(
        views.daily_stale(spark, sf_dir), views.edits(spark, sf_dir), KEYS
    ),
    "set_forecast": lambda spark, sf_dir: ed.set_forecast(
        views.daily(spark, sf_dir), views.edits(spark, sf_dir), KEYS
    ),
    "set_forecast_bucketed": set_forecast_bucketed,
    "edit_report": lambda spark, sf_dir: ed.edit_report(
        views.daily(spark, sf_dir), views.edits(spark, sf_dir), KEYS
    ).drop("message"),
    "upsert_daily": lambda spark, sf_dir: ed.upsert_daily(
        views.daily_stale(spark, sf_dir), views.daily_changes(spark, sf_dir), KEYS
    ),
    "upsert_daily_range_only": lambda spark, sf_dir: ed.upsert_daily(
        views.daily_stale(spark, sf_dir), views.daily_changes(spark, sf_dir), KEYS, recalc_tail=False
    ),
    "clear_all_forecast": on_daily(ed.clear_all_forecast),
    "clear_forecast_range": on_daily(lambda d: ed.clear_forecast_range(d, START, "31/12/1999")),
    "clear_forecast_outcome": on_daily(lambda d: ed.clear_forecast_outcome(d, START, "31/12/1999")),
    "extend_calendar": on_daily(lambda d: ed.extend_calendar(d, 14, keys=KEYS)),
    # forecasts
    "moving_average_forecast": on_daily(lambda d: fc.moving_average_forecast(d, keys=KEYS)),
    "moving_average_series": on_daily(lambda d: fc.moving_average_series(d, keys=KEYS)),
    "moving_average_year": on_daily(lambda d: fc.moving_average_series(d, 365, KEYS)),
    "ses_forecast": on_daily(lambda d: fc.ses_forecast(d, keys=KEYS)),
    "ses_forecast_single": on_daily(fc.ses_forecast, None),
    "forecast_from_date": on_daily(lambda d: fc.forecast_from_date(d, START, keys=KEYS)),
    "future_forecast_rows": on_daily(lambda d: fc.future_forecast_rows(d, keys=KEYS)),
    "demand_forecast_series": on_daily(lambda d: fc.demand_forecast_series(d, keys=KEYS)),
    "persist_forecast": on_daily(
        lambda d: fc.persist_forecast(
            d, fc.future_forecast_rows(d, 14, START, method="moving_average", keys=KEYS), KEYS
        )
    ),
    "persist_forecast_upsert": views.projected,
    "latest_inventory_projected": lambda spark, sf_dir: summary.latest_inventory(
        views.projected(spark, sf_dir), KEYS
    ),
    "apply_edits_projected": lambda spark, sf_dir: ed.apply_edits(
        views.projected(spark, sf_dir), projected_edits(spark, sf_dir), KEYS
    ),
    "forecast_to_plan": lambda spark, sf_dir: forecast_to_plan(
        views.daily_uneven(spark, sf_dir), keys=KEYS
    ).with_status(),
    "forecast_to_plan_outcomes": lambda spark, sf_dir: forecast_to_plan(
        views.daily_uneven(spark, sf_dir), keys=KEYS
    ).outcomes,
    "forecast_to_plan_projected": lambda spark, sf_dir: forecast_to_plan(
        views.projected(spark, sf_dir), 14, keys=KEYS
    ).with_status(),
    # dates and migrations
    "normalize_date": lambda spark, sf_dir: views.date_texts(spark, sf_dir).withColumn(
        "parsed", normalize_date(F.col("raw"), AS_OF)
    ),
    "migrate_date_format": lambda spark, sf_dir: migrate.migrate_date_format(
        views.daily_text_dates(spark, sf_dir)
    ),
    "remap_user_ids": lambda spark, sf_dir: users.remap_user_ids(views.users_int(spark, sf_dir)),
    "remap_message_users": lambda spark, sf_dir: users.remap_message_users(
        views.conversation_history(spark, sf_dir), views.users_int(spark, sf_dir)
    ),
    # users and conversation log
    "get_or_create_users": lambda spark, sf_dir: users.get_or_create_users(
        text_users(spark, sf_dir), views.requested_names(spark, sf_dir)
    ),
    "set_display_name": renamed_users,
    "user_profile": lambda spark, sf_dir: users.user_profile(views.users_int(spark, sf_dir)),
    "session_history": on_log(talk.session_history),
    "user_session_history": on_log(talk.user_session_history),
    "user_sessions": on_log(talk.user_sessions),
    "session_history_single": lambda spark, sf_dir: talk.session_history(stored_log(spark, sf_dir), "c17"),
    "user_session_history_single": lambda spark, sf_dir: talk.user_session_history(
        stored_log(spark, sf_dir), "4", "c24"
    ),
    "user_sessions_single": lambda spark, sf_dir: talk.user_sessions(stored_log(spark, sf_dir), "4"),
    "session_labels": on_log(talk.session_labels),
    "clear_session": cleared_sessions,
    "message_markup": lambda spark, sf_dir: talk.message_markup(
        views.marked_messages(spark, sf_dir)
    ),
    # events
    "debug_messages": lambda spark, sf_dir: ev.debug_messages(views.agent_events(spark, sf_dir)),
    "stream_debug_messages": streamed_messages,
    "two_stage_events": staged_events,
    "stream_apply_edits": streamed_edits,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalculate the stock of every series from its first day and list its stockouts."""
    daily = views.daily_stale(spark, sf_dir)
    return inv.stockouts(inv.recalc_inventory(daily, None, KEYS), KEYS).select(
        *KEYS, DATE, DEMAND, PLAN, INVENTORY
    )
