"""Agent events as debug messages, for batch tables and streams alike."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dayplan.sources.staging import path_exists

logger = logging.getLogger(__name__)

# How each kind of event is announced in the chat.
RAW_TEXT = "📝 Modelo envía: "
TOOL_CALLED = "▶️ Llamada a herramienta "
TOOL_OUTPUT = "✅ Resultado herramienta: "
AGENT_UPDATED = "🤖 Nuevo agente: "
OTHER = "• Evento "


def debug_content() -> Column:
    def said(prefix: str, column: str, missing: str) -> Column:
        return F.concat(F.lit(prefix), F.coalesce(column, F.lit(missing)))

    return (
        F.when(F.col("kind") == "raw_response", said(RAW_TEXT, "text", ""))
        .when(F.col("kind") == "tool_called", said(TOOL_CALLED, "name", "None"))
        .when(F.col("kind") == "tool_output", said(TOOL_OUTPUT, "output", "None"))
        .when(F.col("kind") == "agent_updated", said(AGENT_UPDATED, "name", ""))
        .otherwise(said(OTHER, "name", "None"))
    )


def debug_messages(events: DataFrame) -> DataFrame:
    """One debug message per event; a raw response without text says nothing.

    Row by row, with no state: the same code serves ``read`` and ``readStream``.
    """
    silent = (F.col("kind") == "raw_response") & (F.coalesce("text", F.lit("")) == "")
    return events.filter(~silent).select(
        "session_id", "seq", "ts", F.lit("debug").alias("role"), debug_content().alias("content")
    )


def collect_events(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    transform: Callable[[DataFrame], DataFrame] = debug_messages,
) -> DataFrame:
    """Run a stream to its end into Parquet at ``sink``, calling ``on_batch`` per batch.

    Returns everything collected so far, with the number of the batch that brought it.
    A batch goes to its own folder and replaces what a broken attempt left there, so
    a restart from the checkpoint neither loses nor repeats rows.  An error in the
    callback is logged and does not stop the stream.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        path = f"{sink}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if on_batch is not None:
            try:
                on_batch(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)
            except Exception:
                logger.exception("callback failed for batch %s", batch_id)

    rows = transform(stream)
    query = (
        rows.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    schema = StructType([*rows.schema.fields, StructField("batch", LongType())])
    if not path_exists(spark, sink):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)


def two_stage_events(first: DataFrame, second: DataFrame) -> DataFrame:
    """Events of two agents in turn, each event once per session, stage and number."""
    both = first.withColumn("stage", F.lit(1).cast("bigint")).unionByName(
        second.withColumn("stage", F.lit(2).cast("bigint"))
    )
    return both.dropDuplicates(["session_id", "stage", "seq"])
