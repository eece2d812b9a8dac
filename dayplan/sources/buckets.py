"""The daily table in buckets, so that edit lists travel and daily rows stay.

The table lies in a fixed number of buckets by ``(keys..., date)``, sorted inside them.  A
list of edits is dealt to the same buckets and merged with them: however long the list is,
only its rows are shuffled, and what is written has the buckets of what was read.  A series
with a third of all rows is spread over all buckets, as the date is part of the key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from dayplan.operators.edits import as_edits, fold_edits, write_fields
from dayplan.schema import DATE, FORECAST
from dayplan.sources.staging import delete_path, stage


class BucketedTable:
    """A catalog table of daily rows with one writer at a time.

    ``buckets`` is set for good when the table is created: about the size of the table over
    that of a task's input.  Copies are written below ``location``.  A change writes a new
    copy and gives it the name; if the job fails before that, the table is as it was.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, keys: Sequence[str] = (), buckets: int = 200):
        self.spark, self.name, self.location, self.keys, self.buckets = spark, name, location.rstrip("/"), list(keys), buckets

    def _write(self, rows: DataFrame, name: str) -> None:
        by = [*self.keys, DATE]
        path = f"{self.location}/copy-{uuid.uuid4().hex[:12]}"
        rows.write.format("parquet").bucketBy(self.buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)

    def create(self, daily: DataFrame) -> None:
        """Deal the rows to their buckets, one file each."""
        self._write(daily.repartition(self.buckets, *self.keys, DATE), self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def edited(self, changes: DataFrame, fields: Sequence[str] = (FORECAST,)) -> DataFrame:
        """The table with an edit list ``(keys..., date, field, value, seq)`` applied; the highest
        seq wins, and days that are not in the table change nothing."""
        folded = stage(fold_edits(changes, self.keys, fields), "bucket-edits")
        dealt = folded.repartition(self.buckets, *self.keys, DATE).hint("merge")
        return write_fields(self.read(), dealt, self.keys)

    def update(self, changes: DataFrame, fields: Sequence[str] = (FORECAST,)) -> None:
        """Apply an edit list and keep the result.

        Forecasts move no stock.  After a change of demand or plan the balances are to be
        recalculated (``recalc_inventory``), which shuffles as it always does.
        """
        self._write(self.edited(changes, fields), f"{self.name}_next")
        old = self._path()
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {self.name}_old")
        self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {self.name}_old")
        delete_path(self.spark, old)

    def set_forecast(self, changes: DataFrame) -> None:
        """``(keys..., date, value[, seq])`` as new forecasts."""
        self.update(as_edits(changes, FORECAST))

    def _path(self) -> str:
        told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'")
        return told.first()["data_type"]

    def drop(self) -> None:
        path = self._path()
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_path(self.spark, path)
