"""A daily table whose balances can be recalculated without touching every later day.

The stock of a day is cut in two: the balance at the opening of its year, kept once per
series and year in a small table, and the balance inside the year, kept with the day.  A
changed day then alters the days of its own year only; for the years after it one number
each is carried forward.  An edit of last week rewrites one year of the table, however far
the calendar goes on, and an edit of an old year does not rewrite the years behind it.

``days`` and ``years`` are Parquet partitioned by year and changed by Spark's dynamic
partition overwrite.  A year of a series is *clean* if its inside balances follow from its
flows.  Tables may hold stored balances that do not; a recalculation that comes by such a
year from an earlier one rewrites it once, and it is clean from then on.

A change writes ``days`` first and ``years`` then.  If it is cut off between the two, the same
edit list again completes it, as edits set values and balances are computed from their start.
One writer at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.operators.edits import fold_edits, overwrite
from dayplan.operators.inventory import net_flow
from dayplan.operators.running import YEAR, with_year
from dayplan.schema import (
    DAILY_COLUMNS,
    DATE,
    DEMAND,
    FORECAST,
    INVENTORY,
    PLAN,
    Keys,
    date_value,
    is_projected,
    real_day,
)
from dayplan.sources.staging import short_lived, stage

INSIDE = "inside"
#: The partition column: the year as a number.
PART = "year"


class BalanceTable:
    def __init__(self, spark: SparkSession, root: str, keys: Keys = ()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = list(keys)

    def create(self, daily: DataFrame) -> BalanceTable:
        """Store ``daily`` with the balances it has."""
        with short_lived(self.spark):
            rows = with_year(daily.select(*self.keys, *DAILY_COLUMNS))
            series = W.partitionBy(*self.keys).orderBy(YEAR)
            lasts = rows.groupBy(*self.keys, YEAR).agg(F.max_by(INVENTORY, real_day()).alias("last"))
            # The stored balance of the last real day before the year.
            before = F.last("last", ignorenulls=True).over(series.rowsBetween(W.unboundedPreceding, -1))
            bases = stage(lasts.select(*self.keys, YEAR, F.coalesce(before, F.lit(0)).cast("bigint").alias("base")), "bases")
            days = rows.join(bases, [*self.keys, YEAR]).withColumn(INSIDE, F.col(INVENTORY) - F.col("base"))
            days = days.withColumn("_real", ~is_projected()).drop(INVENTORY)
            flow = F.when(F.col("_real"), net_flow("zero")).otherwise(F.lit(0))
            order = W.partitionBy(*self.keys, YEAR).orderBy(DATE).rowsBetween(W.unboundedPreceding, 0)
            days = days.withColumn("_follows", ~F.col("_real") | F.coalesce(F.sum(flow).over(order) == F.col(INSIDE), F.lit(False)))
            years = days.groupBy(*self.keys, YEAR).agg(
                F.first("base").alias("base"), self._close().alias("close"), F.every("_follows").alias("clean")
            )
            self._write(years, "years")
            self._write(days.drop("base", "_real", "_follows"), "days")
        return self

    @staticmethod
    def _close() -> Column:
        """What a year adds to the stock: the inside balance of its last real day."""
        return F.coalesce(F.max_by(INSIDE, F.when(F.col(INSIDE).isNotNull(), F.col(DATE))), F.lit(0)).cast("bigint")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows = rows.withColumn(PART, F.year(YEAR)).hint("rebalance", F.col(PART))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART).parquet(f"{self.root}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def days(self) -> DataFrame:
        """Rows as they are stored, with the year both as a date and as partition."""
        return self._read("days")

    def years(self) -> DataFrame:
        return self._read("years")

    def read(self) -> DataFrame:
        """The daily table.  Year rows are few; Spark broadcasts them or sorts by their size."""
        bases = self.years().select(*self.keys, YEAR, "base")
        rows = self.days().join(bases, [*self.keys, YEAR])
        return rows.withColumn(INVENTORY, F.col("base") + F.col(INSIDE)).select(*self.keys, *DAILY_COLUMNS)

    def recalc_inventory(self, start: str | dt.date | Column, on_null: str = "error") -> list[int]:
        """Carry balances forward from ``start``; returns the years that were rewritten."""
        with short_lived(self.spark):
            begin = date_value(start)
            own = self.years().filter(F.col(YEAR) >= F.trunc(begin, "year"))
            # A series without a day in the starting year begins with its next one.
            starts = own.groupBy(*self.keys).agg(F.min(YEAR).alias("_first")).withColumn(
                "start", F.greatest(begin, F.col("_first"))
            )
            return self._change(starts.select(*self.keys, "start"), None, None, on_null)

    def apply_edits(self, edits: DataFrame, on_null: str = "error") -> list[int]:
        """Write the edits and recalculate each touched series from its first changed day;
        returns the years that were rewritten."""
        with short_lived(self.spark):
            folded = stage(fold_edits(edits, self.keys), "edits")
            asked = self._parts(folded.select(F.year(DATE).alias(PART)))
            real = (F.col(PLAN).isNotNull() | F.col(DEMAND).isNotNull() | F.col(INSIDE).isNotNull()).alias("_real")
            held = self.days().filter(F.col(PART).isin(asked)).select(*self.keys, DATE, YEAR, real)
            hits = stage(held.join(folded, [*self.keys, DATE]), "hits")
            moving = hits.filter(F.col("_real") & F.coalesce(f"_new_{PLAN}", f"_new_{DEMAND}").isNotNull())
            starts = stage(moving.groupBy(*self.keys).agg(F.min(DATE).alias("start")), "starts")
            return self._change(starts, moving.select(*self.keys, YEAR).distinct(), hits, on_null)

    def _parts(self, rows: DataFrame) -> list[int]:
        """The distinct partitions: as many numbers as the calendar has years."""
        return sorted(row[PART] for row in rows.select(PART).distinct().collect() if row[PART] is not None)

    def _change(self, starts: DataFrame, moved: DataFrame | None, hits: DataFrame | None, on_null: str) -> list[int]:
        keys = self.keys
        first = F.trunc("start", "year")
        begins = starts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "start", first.alias("_first"))
        same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
        behind = self.years().join(begins, [*same, F.col(YEAR) >= F.col("_first")] if keys else F.col(YEAR) >= F.col("_first"))
        behind = stage(behind.select(*keys, YEAR, "base", "close", "clean", "start", "_first"), "behind")
        # The starting year, the edited years, and later ones that are not clean.
        todo = behind.filter((F.col(YEAR) == F.col("_first")) | ~F.col("clean")).select(*keys, YEAR)
        if moved is not None:
            todo = todo.unionByName(moved).distinct()
        at = F.when(F.col(YEAR) == F.col("_first"), F.col("start")).otherwise(F.col(YEAR)).alias("_from")
        touched = stage(behind.join(todo, [*keys, YEAR], "left_semi").select(*keys, YEAR, at), "touched")
        parts = set(self._parts(touched.select(F.year(YEAR).alias(PART))))
        rows = self.days()
        if hits is not None:
            parts |= set(self._parts(hits.select(F.year(YEAR).alias(PART))))
        if not parts:
            return []
        rows = rows.filter(F.col(PART).isin(sorted(parts))).drop(PART).withColumnRenamed(INSIDE, INVENTORY)
        if hits is not None:
            new = hits.drop(YEAR, "_real")
            rows = overwrite(rows.join(new, [*keys, DATE], "left"), (PLAN, DEMAND, FORECAST))
        rows = rows.join(touched, [*keys, YEAR], "left").withColumn("_real", ~is_projected())
        year = W.partitionBy(*keys, YEAR)
        old = F.col("_real") & (F.col(DATE) < F.col("_from"))
        active = F.coalesce(F.col("_real") & (F.col(DATE) >= F.col("_from")), F.lit(False))
        opening = F.coalesce(F.max_by(F.when(old, F.col(INVENTORY)), F.when(old, F.col(DATE))).over(year), F.lit(0))
        order = year.orderBy(DATE).rowsBetween(W.unboundedPreceding, 0)
        total = opening + F.sum(F.when(active, net_flow(on_null)).otherwise(F.lit(0))).over(order)
        inside = F.when(active, total.cast("bigint")).otherwise(F.col(INVENTORY))
        fresh = rows.withColumn(INSIDE, inside)
        # Staged, as the year rows are made from the same days that replace the stored ones.
        fresh = stage(fresh.select(*keys, DATE, DEMAND, PLAN, FORECAST, YEAR, INSIDE, "_from"), "fresh")
        closes = fresh.filter(F.col("_from").isNotNull()).groupBy(*keys, YEAR).agg(
            self._close().alias("_close"),
            (F.min(F.when(F.col(INSIDE).isNotNull(), F.col(DATE))) >= F.first("_from")).alias("_whole"),
        )
        series = W.partitionBy(*keys).orderBy(YEAR)
        carried = F.coalesce(F.sum("_new_close").over(series.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        updated = (
            behind.join(closes, [*keys, YEAR], "left")
            .withColumn("_new_close", F.coalesce("_close", "close"))
            .withColumn("_opening", F.first("base").over(series))
            .select(
                *keys, YEAR, (F.col("_opening") + carried).cast("bigint").alias("base"),
                F.col("_new_close").alias("close"), (F.col("clean") | F.coalesce("_whole", F.lit(False))).alias("clean"),
            )
        )
        late = self._parts(behind.select(F.year(YEAR).alias(PART)))
        other = self.years().filter(F.col(PART).isin(late)).drop(PART).join(behind, [*keys, YEAR], "left_anti")
        years = stage(updated.unionByName(other.select(*updated.columns)), "years")
        self._write(fresh.drop("_from"), "days")
        self._write(years, "years")
        return sorted(parts)
