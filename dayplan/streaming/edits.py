"""A stream of edits applied to a stored daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dayplan.operators.edits import apply_edits
from dayplan.schema import Keys
from dayplan.sources.staging import short_lived, stage
from dayplan.sources.tables import StoredTable


def write_edits(table: StoredTable, edits: DataFrame, keys: Keys = ()) -> None:
    """Apply an edit list; only the partitions that it can change are rewritten."""
    with short_lived(table.spark):
        table.change(edits, lambda rows: apply_edits(rows, edits, keys))


def stream_apply_edits(
    edits: DataFrame, table: StoredTable, checkpoint: str, keys: Keys = ()
) -> DataFrame:
    """Apply each arriving batch to the table; returns the final table.

    Within a batch the last writer per key and field wins, across batches the later
    batch.  The table notes the last batch it holds, so a batch that is replayed after a
    restart is skipped.  One that was written but not noted is written again, with the same
    result: edits set values, they do not add to them.  What a batch stages is deleted with it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id > table.last_batch(checkpoint):
            with short_lived(table.spark):
                write_edits(table, stage(batch, "batch"), keys)
            table.note_batch(checkpoint, batch_id)

    query = (
        edits.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
