"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.sources.staging import stage

#: ASCII white space, and what is left between it.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Where the tokenizer's file lies on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words(text: Column | str) -> Column:
    """The words of a text in order; none for a missing text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a variation of it that is no column of ``df``."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def content_key(*columns: str) -> Column:
    """128 bits that stand for the values of ``columns``; NULL and '' differ."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts += [F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(value).cast("string"), F.lit(":"), value))]
    return F.unhex(F.md5(F.concat(*parts)))


def running_start(
    rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], size: str, into: str
) -> DataFrame:
    """The sum of ``size`` over the earlier rows of each group, without one task per group.

    ``bucket`` cuts a group into consecutive pieces in the order of ``order``.  Pieces are
    summed with map-side combine, put in order as one small row each, and joined back, so
    that rows only ever meet inside their own piece.  The piece sums are written once: Spark
    then knows their size before it decides between a broadcast and a shuffle.
    """
    start = "_piece_start"
    pieces = rows.groupBy(*group, bucket).agg(F.sum(size).alias("_piece_size"))
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = stage(
        pieces.select(*group, bucket, F.coalesce(F.sum("_piece_size").over(earlier), F.lit(0)).alias(start)),
        "piece-starts",
    )
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(starts, [*group, bucket])
        .withColumn(into, (F.col(start) + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("bigint"))
        .drop(start)
    )
