"""Stored tables: partitioned Parquet that Spark's own writers change in part.

A table is a folder of Parquet partitioned by month, by year, or by a number that stands for
the series.  A change rewrites only the partitions it touches, by Spark's dynamic partition
overwrite: new files are written beside the old ones and take their place when the job
commits, so a job that fails leaves the table as it was.  Beside the rows lie one small
Parquet table with the settings and the schema, and one with the last batch taken from each
stream.

There are no versions and there is no isolation of writers: one writer at a time, and a
DataFrame made before a change is not to be read after it.  Use a table format with
transactions where that is not enough.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayplan.schema import DATE, Keys
from dayplan.sources.staging import delete_path, path_exists

# Partition columns that hold a part of the date.
LAYOUTS = {"month": "yyyy-MM", "year": "yyyy"}
SERIES_PART = "series_part"
SETTINGS = "layout string, keys array<string>, parts int, schema string, sorted_by array<string>, blooms array<string>"
MARKS = "stream string, batch bigint"


def series_part(keys: Keys, parts: int) -> Column:
    """The number of the part that holds a series."""
    if not keys:
        return F.lit(0)
    named = [F.col(key).cast("string") for key in keys]
    return F.pmod(F.xxhash64(*named), F.lit(parts)).cast("int")


class StoredTable:
    """``layout`` is ``"month"``, ``"year"``, ``"series"`` (``parts`` parts by ``keys``) or None."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._settings = None

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.root}/settings/_SUCCESS")

    def create(
        self,
        table: DataFrame,
        layout: str | None = "month",
        keys: Keys = (),
        parts: int = 64,
        sorted_by: Keys = (),
        blooms: Keys = (),
    ) -> StoredTable:
        """Write ``table`` as a new stored table.

        Without partitions, the rows of each write can be put in the order of ``sorted_by``
        over its files, so that the value ranges of row groups tell values apart; columns in
        ``blooms`` get Bloom filters, which do so where the order does not.
        """
        if layout not in (None, "series", *LAYOUTS):
            raise ValueError(f"unknown layout {layout!r}")
        if self.exists():
            raise FileExistsError(f"there is a table at {self.root} already")
        self._settings = {"layout": layout, "keys": list(keys), "parts": parts, "schema": table.schema}
        self._settings |= {"sorted_by": list(sorted_by), "blooms": list(blooms)}
        self._write(table, "overwrite")
        row = (layout, list(keys), parts, table.schema.json(), list(sorted_by), list(blooms))
        self.spark.createDataFrame([row], SETTINGS).coalesce(1).write.parquet(f"{self.root}/settings")
        return self

    @property
    def settings(self) -> dict:
        """Layout, keys, parts and schema; they never change."""
        if self._settings is None:
            if not self.exists():
                raise FileNotFoundError(f"there is no table at {self.root}")
            row = self.spark.read.schema(SETTINGS).parquet(f"{self.root}/settings").first().asDict()
            self._settings = {**row, "schema": StructType.fromJson(json.loads(row["schema"]))}
        return self._settings

    def partition_column(self) -> str | None:
        layout = self.settings["layout"]
        return SERIES_PART if layout == "series" else layout

    def read(self) -> DataFrame:
        return self.with_layout().select(*self.settings["schema"].fieldNames())

    def with_layout(self) -> DataFrame:
        """The rows with their partition column, so that conditions on it prune the files."""
        column = self.partition_column()
        schema = StructType(list(self.settings["schema"].fields))
        if column:
            schema = schema.add(column, "integer" if column == SERIES_PART else "string")
        if not path_exists(self.spark, f"{self.root}/data"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/data")

    def between(self, first: Column, last: Column | None = None) -> Column:
        """A condition for the partitions that hold days from ``first`` to ``last``.

        True for all rows where the layout does not tell dates apart.
        """
        layout = self.settings["layout"]
        if layout not in LAYOUTS:
            return F.lit(True)
        inside = F.col(layout) >= F.date_format(first, LAYOUTS[layout])
        if last is not None:
            inside &= F.col(layout) <= F.date_format(last, LAYOUTS[layout])
        return inside

    def overwrite(self, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` belong to, which must be whole; leave the others."""
        self._write(rows, "overwrite")

    def change(self, changes: DataFrame, edit: Callable[[DataFrame], DataFrame]) -> None:
        """Write what ``edit`` makes of the table, where ``changes`` can have an effect.

        By series that is the parts that hold a changed series, at most ``parts`` numbers; only
        they are read.  By date it is the partitions from the first changed day on, as balances
        are carried forward from day to day; earlier ones are read for balances at most.
        """
        settings = self.settings
        if settings["layout"] == "series":
            number = series_part(settings["keys"], settings["parts"]).alias("part")
            parts = [row.part for row in changes.select(number).distinct().collect()]
            self.overwrite(edit(self.with_layout().filter(F.col(SERIES_PART).isin(parts))))
            return
        first = changes.agg(F.min(DATE).alias("first")).first()["first"]
        if first is not None:
            column = self.partition_column()
            rows = edit(self.with_layout())
            if column not in rows.columns:
                rows = rows.withColumn(column, F.date_format(DATE, LAYOUTS[column]))
            self.overwrite(rows.filter(self.between(F.lit(first))))

    def append(self, rows: DataFrame) -> None:
        """Add rows; the files already there are not touched."""
        self._write(rows, "append")

    def clear(self) -> None:
        """Remove all rows."""
        delete_path(self.spark, f"{self.root}/data")

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that the table holds, -1 for none."""
        if not path_exists(self.spark, f"{self.root}/marks"):
            return -1
        marks = self.spark.read.schema(MARKS).parquet(f"{self.root}/marks")
        return marks.filter(F.col("stream") == stream).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def note_batch(self, stream: str, batch: int) -> None:
        mark = self.spark.createDataFrame([(stream, batch)], MARKS)
        mark.coalesce(1).write.mode("append").parquet(f"{self.root}/marks")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rows are spread with a rebalance, which lets adaptive execution split a partition
        that is large and join those that are small."""
        settings, column = self.settings, self.partition_column()
        rows = rows.select(*settings["schema"].fieldNames())
        path = f"{self.root}/data"
        if column is None:
            if mode == "overwrite" and path_exists(self.spark, path):
                raise ValueError("a table without partitions can only be appended to")
            if settings["sorted_by"]:
                rows = rows.repartitionByRange(*settings["sorted_by"]).sortWithinPartitions(*settings["sorted_by"])
            writer = rows.write.mode("append")
            for name in settings["blooms"]:
                writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
            writer.parquet(path)
            return
        if column == SERIES_PART:
            rows = rows.withColumn(column, series_part(settings["keys"], settings["parts"]))
        else:
            rows = rows.withColumn(column, F.date_format(DATE, LAYOUTS[column]))
        writer = rows.hint("rebalance", F.col(column)).write.mode(mode).partitionBy(column)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def publish_snapshot(daily: DataFrame, root: str) -> DataFrame:
    """Store ``daily`` as a table by month at ``root`` and read it back."""
    return StoredTable(daily.sparkSession, root).create(daily).read().select(*daily.columns)
