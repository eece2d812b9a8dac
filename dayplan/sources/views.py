"""Planning tables derived from the order, event, conversation and customer tables.

Production is booked on the order date, demand falls on the ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayplan.operators.forecast import future_forecast_rows, persist_forecast
from dayplan.operators.running import number_rows, running_total
from dayplan.schema import DAILY_COLUMNS, DATE, DEMAND, FORECAST, INVENTORY, PLAN, bigint
from dayplan.sources.staging import stage_once

SERIES = "series_key"
SPANISH_MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
# The part column that names a series, by the kind of series asked for.
SERIES_COLUMNS = {"brand": "p_brand", "type": "p_type", "part": "l_partkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_flows(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    """Demand and production per series and day, from one scan of the line items.

    A line adds to two days, so it becomes two rows which are summed before they
    are shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("booked")
    )
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    keys = [] if by is None else [SERIES]
    if by in ("brand", "type"):
        parts = table(spark, sf_dir, "part").select("p_partkey", SERIES_COLUMNS[by])
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if by is not None:
        rows = rows.withColumn(SERIES, F.col(SERIES_COLUMNS[by]).cast("string"))
    none = F.lit(0.0)
    both = rows.select(
        *keys,
        F.stack(
            F.lit(2),
            F.col("ship"), F.col("l_quantity"), none,
            F.col("booked"), none, F.col("l_quantity"),
        ).alias(DATE, DEMAND, PLAN),
    )
    return (
        both.filter(F.col(DATE).isNotNull())
        .groupBy(*keys, DATE)
        .agg(bigint(F.sum(DEMAND)).alias(DEMAND), bigint(F.sum(PLAN)).alias(PLAN))
    )


def build_daily(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    keys = [] if by is None else [SERIES]
    day = F.dayofmonth(DATE)
    flows = daily_flows(spark, sf_dir, by).withColumn(
        FORECAST, F.when(day % 5 != 0, bigint(F.col(DEMAND) + day % 7 - 3))
    )
    total = running_total(flows, keys, F.col(PLAN) - F.col(DEMAND), INVENTORY)
    return total.select(*keys, *DAILY_COLUMNS)


def daily(spark: SparkSession, sf_dir: str, by: str | None = "brand") -> DataFrame:
    """The daily table, written once per application and read back like any stored table."""
    return stage_once(
        spark, f"daily-{by or 'all'}", sf_dir, lambda: build_daily(spark, sf_dir, by)
    )


def daily_stale(spark: SparkSession, sf_dir: str, by: str | None = "brand") -> DataFrame:
    """The daily table with a stored inventory that is off by one to three."""
    off = F.dayofmonth(DATE) % 3 + 1
    return daily(spark, sf_dir, by).withColumn(INVENTORY, bigint(F.col(INVENTORY) + off))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan edits on every 15th, demand edits on every 20th, a second plan edit in June,
    and one edit of a day that does not exist."""
    rows = daily(spark, sf_dir)
    day, month = F.dayofmonth(DATE), F.month(DATE)

    def edit(chosen, field, extra, seq):
        return F.when(
            chosen,
            F.struct(
                F.lit(field).alias("field"),
                (F.col(DEMAND) + extra).alias("value"),
                F.lit(seq).cast("bigint").alias("seq"),
            ),
        )

    stray = spark.range(1).select(
        F.lit("NO_SUCH_KEY").alias(SERIES),
        F.lit("1990-01-01").cast("date").alias(DATE),
        F.lit(DEMAND).alias("field"),
        F.lit(1).cast("bigint").alias("value"),
        F.lit(4).cast("bigint").alias("seq"),
    )
    made = F.array_compact(
        F.array(
            edit(day == 15, PLAN, 10, 1),
            edit(day == 20, DEMAND, 25, 2),
            edit((day == 15) & (month == 6), PLAN, 30, 3),
        )
    )
    return rows.select(SERIES, DATE, F.inline(made)).unionByName(stray)


def build_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    minutes = ((F.col("conv_id") * 7919) % 43200 + F.col("turn")).cast("int")
    rows = said.select(
        "conv_id",
        "turn",
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.when(F.col("conv_id") % 10 != 9, (F.col("conv_id") % 20).cast("string")).alias("user_id"),
        "role",
        F.col("text").alias("content"),
        F.timestamp_add(
            "MINUTE", minutes, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        ).alias("timestamp"),
    )
    return number_rows(rows, ["conv_id", "turn"]).drop("conv_id", "turn")


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, "history", sf_dir, lambda: build_history(spark, sf_dir))


def users_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with whole-number ids, some without a display name."""
    rest = F.col("c_custkey") % 3
    name = F.when(rest == 1, "").when(
        rest == 2, F.concat(F.lit("D"), F.col("c_custkey").cast("string"))
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), name.alias("display_name")
    )


def event_columns(events: DataFrame) -> DataFrame:
    """Raw events as agent events, for a batch table or a stream."""
    kind = F.col("event_type")
    silent = (kind == "view") & (F.col("event_id") % 2 == 0)
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind == "view", "raw_response")
        .when(kind == "click", "tool_called")
        .when(kind == "purchase", "tool_output")
        .when(kind == "signup", "agent_updated")
        .otherwise("other")
        .alias("kind"),
        kind.alias("name"),
        F.when(~silent, F.col("props")).alias("text"),
        F.col("props").alias("output"),
    )


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def agent_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return event_columns(stream.parquet(sf_dir))


def requested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User names to look up: every customer, who exists, and every supplier, who does not."""
    known = table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"))
    return known.unionByName(
        table(spark, sf_dir, "supplier").select(F.col("s_name").alias("username"))
    )


def log_with_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation log plus one debug row per raw event, at the end of its session."""
    log = conversation_history(spark, sf_dir).select("session_id", "id", "role", "content")
    said = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("session_id"),
        (F.col("event_id") + 1_000_000_000_000).alias("id"),
        F.lit("debug").alias("role"),
        F.col("props").alias("content"),
    )
    return log.unionByName(said)


def marked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with markup: conversations with marks at commas and full stops, and
    documents as they are."""
    head = F.concat(F.lit("- **"), F.col("role"), F.lit("** *said*\n"))
    body = F.replace(F.col("text"), F.lit(", "), F.lit(" **"))
    body = F.replace(body, F.lit(". "), F.lit("* \n - "))
    said = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(head, body).alias("content"),
    )
    return said.unionByName(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("id"), F.lit("documents").alias("session_id"),
            F.col("text").alias("content"),
        )
    )


def daily_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table with series of at most nine days, and with days that lack a demand."""
    rows = daily(spark, sf_dir)
    short = F.col(SERIES).endswith("1") & (F.col(DATE) >= F.lit("1995-01-10").cast("date"))
    gap = F.col(SERIES).endswith("2") & (F.dayofmonth(DATE) == 13)
    return rows.filter(~short).withColumn(DEMAND, F.when(~gap, F.col(DEMAND)))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table with two weeks of stored projections beyond the history of each series."""
    rows = daily(spark, sf_dir)
    ahead = future_forecast_rows(rows, 14, keys=[SERIES])
    return persist_forecast(rows, ahead, [SERIES], "upsert")


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the daily table written in one of sixteen ways."""
    day = F.dayofmonth(DATE)
    english = F.date_format(DATE, "MMMM")
    spanish = F.element_at(F.array(*[F.lit(name) for name in SPANISH_MONTHS]), F.month(DATE))
    year, number = F.year(DATE).cast("string"), day.cast("string")
    counted = F.month(DATE).cast("string")
    forms = [
        F.date_format(DATE, "yyyy-MM-dd"),
        F.date_format(DATE, "dd-MM-yyyy"),
        F.date_format(DATE, "d/M/yyyy"),
        F.concat(english, F.lit(" "), F.year(DATE).cast("string")),
        F.concat(F.lower(F.date_format(DATE, "MMM")), F.lit("  "), F.year(DATE).cast("string")),
        F.upper(english),
        F.concat(F.lit("31-02-"), F.year(DATE).cast("string")),
        F.element_at(
            F.array(*[F.lit(word) for word in ("today", "Yesterday", "tomorrow", "junk")]),
            F.month(DATE) % 4 + 1,
        ),
        F.concat(english, F.lit(" "), number, F.lit(", "), year),
        F.concat(english, F.lit(" "), number, F.lit("th "), year),
        F.date_format(DATE, "dd.MM.yyyy"),
        F.date_format(DATE, "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.lit("in "), counted, F.lit(" days")),
        F.concat(counted, F.lit(" weeks ago")),
        F.concat(number, F.lit(" de "), spanish, F.lit(" de "), year),
        F.concat(F.initcap(spanish), F.lit(" "), year),
    ]
    chosen = F.element_at(F.array(*forms), day % 16 + 1)
    return daily(spark, sf_dir, None).select(DATE, chosen.alias("raw"))


def daily_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand by a text date: ISO, unpadded ISO and day-first text, with two kinds of
    clash and one row that is no date."""
    day = F.dayofmonth(DATE)

    def text(chosen, layout, extra=0):
        named = F.date_format(DATE, layout).alias("date_text")
        return F.when(chosen, F.struct(named, (F.col(DEMAND) + extra).alias(DEMAND)))

    made = F.array_compact(
        F.array(
            text(day % 3 == 0, "yyyy-MM-dd"),
            text(day % 3 == 1, "dd-MM-yyyy"),
            text(day % 3 == 2, "yyyy-M-d"),
            text(day == 3, "dd-MM-yyyy", 1),
            text(day == 4, "d-M-yyyy", 2),
        )
    )
    junk = spark.range(1).select(
        F.lit("not-a-date").alias("date_text"), F.lit(0).cast("bigint").alias(DEMAND)
    )
    return daily(spark, sf_dir, None).select(F.inline(made)).unionByName(junk)


def daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to upsert: part of them exist, part lie beyond the calendar."""
    rows = daily(spark, sf_dir).filter(F.col(DATE) >= F.lit("2000-06-01").cast("date"))
    return rows.select(
        SERIES,
        F.date_add(DATE, 400).alias(DATE),
        (F.col(DEMAND) + 1).alias(DEMAND),
        (F.col(PLAN) + 2).alias(PLAN),
        FORECAST,
    )
