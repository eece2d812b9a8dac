"""The conversation log: appends, reads, session views and message markup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.functions.markup import parsed_lines
from dayplan.operators.running import number_rows
from dayplan.schema import MESSAGE_SCHEMA, bigint
from dayplan.sources.tables import StoredTable
from dayplan.sources.staging import stage

# Label texts and the layouts a stored timestamp may have.
UNKNOWN_DATE = "fecha desconocida"
NEW_SESSION = "nueva sesión"
LABEL_LAYOUT = "dd/MM/yyyy HH:mm"
TIMESTAMP_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
]

MESSAGE_COLUMNS = MESSAGE_SCHEMA.fieldNames()


def append_messages(log: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The batch with ids that follow the largest id of the log, ready to be appended.

    ``batch`` has ``session_id, role, content, timestamp`` and optionally ``user_id``;
    ``order`` must be unique within it (default: timestamp, session, role, content).
    Only the batch is numbered, never the log.
    """
    if "user_id" not in batch.columns:
        batch = batch.withColumn("user_id", F.lit(None).cast("string"))
    order = order or ["timestamp", "session_id", "role", "content"]
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    return number_rows(batch, order, "id", after=last).select(*MESSAGE_COLUMNS)


def appended_log(log: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The log followed by the numbered batch."""
    return log.select(*MESSAGE_COLUMNS).unionByName(append_messages(log, batch, order))


def create_log(table: StoredTable, log: DataFrame) -> StoredTable:
    """Store a log in the order of its sessions, with Bloom filters for sessions and users.

    A read of one session then takes a few row groups of each written batch, and one of a user
    those that hold the user.
    """
    rows = log.select(*MESSAGE_COLUMNS)
    return table.create(rows, layout=None, sorted_by=["session_id", "id"], blooms=["session_id", "user_id"])


def save_messages(table: StoredTable, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Append a batch to a stored log and return its rows with their ids.

    Batches are numbered after the log that is there, so a log has one writer at a time.
    """
    if not table.exists():
        create_log(table, table.spark.createDataFrame([], MESSAGE_SCHEMA))
    rows = stage(append_messages(table.read(), batch, order), "messages")
    table.append(rows)
    return rows


def session_history(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """Messages of one session, or of every session, in the order they were stored."""
    rows = log if session_id is None else log.filter(F.col("session_id") == session_id)
    return rows.select("session_id", "id", "role", "content").orderBy("session_id", "id")


def user_session_history(
    log: DataFrame, user_id: str | None = None, session_id: str | None = None
) -> DataFrame:
    """The same, limited to messages that belong to a user."""
    known = F.col("user_id").isNotNull() if user_id is None else F.col("user_id") == user_id
    rows = log.filter(known)
    if session_id is not None:
        rows = rows.filter(F.col("session_id") == session_id)
    return rows.select("user_id", "session_id", "id", "role", "content").orderBy(
        "user_id", "session_id", "id"
    )


def user_sessions(log: DataFrame, user_id: str | Column | None = None) -> DataFrame:
    """Sessions of a user, newest first by their first message; of every user without one."""
    known = F.col("user_id").isNotNull() if user_id is None else F.col("user_id") == user_id
    return (
        log.filter(known)
        .groupBy("user_id", "session_id")
        .agg(F.min("timestamp").alias("min_time"))
        .orderBy("user_id", F.desc("min_time"), "session_id")
    )


def clear_session(log: DataFrame, sessions: str | DataFrame) -> DataFrame:
    """The log without one session, or without every session listed in ``sessions``.

    The list is not made distinct first: an anti-join does not need it, and Spark can
    split a long session only if the join reads its shuffles directly.
    """
    if isinstance(sessions, DataFrame):
        return log.join(sessions.select("session_id"), "session_id", "left_anti").select(*log.columns)
    return log.filter(~F.col("session_id").eqNullSafe(F.lit(sessions)))


def agent_context(log: DataFrame) -> DataFrame:
    """What an agent is given to read: no debug rows, and not the last, unanswered row.

    The last row of a session is the placeholder for the answer being written.  It is
    found by a maximum, so a long session is never sorted in one task.
    """
    last = log.groupBy("session_id").agg(F.max("id").alias("id"))
    kept = log.filter(~F.col("role").eqNullSafe(F.lit("debug")))
    return kept.join(last, ["session_id", "id"], "left_anti").select(
        "session_id", "id", "role", "content"
    )


def session_labels(log: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Each session with the time of its first message as ``dd/MM/yyyy HH:mm``.

    ``timestamp`` may be text in one of the accepted layouts.  ``sessions`` may name
    sessions that have no message yet.
    """
    first = log.groupBy("session_id").agg(F.min_by("timestamp", "id").alias("_first"))
    first = first.withColumn("_first", F.col("_first").cast("string"))
    if sessions is not None:
        first = sessions.select("session_id").distinct().join(first, "session_id", "left")
    parsed = F.coalesce(
        *[F.try_to_timestamp("_first", F.lit(layout)) for layout in TIMESTAMP_LAYOUTS]
    )
    label = (
        F.when(F.coalesce("_first", F.lit("")) == "", NEW_SESSION)
        .when(parsed.isNull(), UNKNOWN_DATE)
        .otherwise(F.date_format(parsed, LABEL_LAYOUT))
    )
    return first.select("session_id", label.alias("label"))


def message_markup(log: DataFrame) -> DataFrame:
    """Shown text and the number of bold spans, italic spans and list items per message."""
    lines = log.select("id", "session_id", parsed_lines(F.col("content")).alias("_lines"))

    def count(field: str) -> Column:
        return F.aggregate("_lines", F.lit(0), lambda n, line: n + line[field].cast("int"))

    return lines.select(
        "id",
        "session_id",
        F.array_join(F.transform("_lines", lambda line: line["shown"]), "\n").alias("plain_text"),
        bigint(count("bold")).alias("bold_spans"),
        bigint(count("italic")).alias("italic_spans"),
        bigint(count("item")).alias("list_items"),
    )


def new_message(
    spark, session_id: str, role: str, content: str, at: dt.datetime, user_id: str | None = None
) -> DataFrame:
    """A batch of one message."""
    return spark.range(1).select(
        F.lit(session_id).alias("session_id"),
        F.lit(user_id).cast("string").alias("user_id"),
        F.lit(role).alias("role"),
        F.lit(content).alias("content"),
        F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz").alias("timestamp"),
    )
