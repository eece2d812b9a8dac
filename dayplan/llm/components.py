"""Connected components of links by rounds of stars, without any node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayplan.sources.staging import stage

MAX_ROUNDS = 60


def _to_smallest(links: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's larger (``both_ways``) or smaller neighbours linked to its smallest one."""
    around = links
    if both_ways:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = around.join(least, "a")
    if both_ways:
        return met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node.

    Alternates large stars and small stars until nothing changes.  Every round is a minimum
    with map-side combine and a join whose large partitions can be split, and is written
    down.  Links of a node to itself, repeated links and NULL ends are left out.
    """
    bigger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = links.filter("a is not null and b is not null and a != b").select(bigger.alias("a"), smaller.alias("b")).distinct()
    now = stage(now, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark
        stars = _to_smallest(_to_smallest(now, True), False)
        now = stage(stars.filter("a != b").distinct(), "links")
    raise RuntimeError("components did not settle")
