"""URL filters by a temporal list join (operator 4).

Dated list entries become validity intervals.  A capture of a URL is matched with the
entries for its hosts and path prefixes that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.llm.common import free_name
from dayplan.sources.staging import stage

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: str) -> Column:
    """The lower-case host, without dots at its end; empty if there is none."""
    return F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def url_keys(url: str) -> Column:
    """Patterns that match a URL: its host, parent domains of two labels or more, and the host
    with each prefix of its path that ends at a segment."""
    labels = F.split(host_of(url), r"\.", -1)
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")
    depth = F.size(steps)
    below = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host_of(url) == "", none).otherwise(F.concat(parents, F.coalesce(below, none)))


def validity(entries: DataFrame) -> DataFrame:
    """``(list_name, kind, pattern, valid_from, valid_to)`` from dated adds and removes.

    An entry holds until the next one of its list, kind and pattern; ``valid_to`` is missing
    for the last.  Of entries at one time a remove wins.  Entries are put in order inside a
    year, and years by their first entry, so that a pattern with a long history is not one
    task's.  Entries without a pattern or date are left out.
    """
    keys = ["list_name", "kind", "pattern"]
    dated = entries.filter("pattern is not null and dated is not null and action in ('add', 'remove')")
    once = dated.groupBy(*keys, "dated").agg(F.max("action").alias("action")).withColumn("year", F.year("dated"))
    inside = F.lead("dated").over(W.partitionBy(*keys, "year").orderBy("dated"))
    firsts = once.groupBy(*keys, "year").agg(F.min("dated").alias("first"))
    later = firsts.select(*keys, "year", F.lead("first").over(W.partitionBy(*keys).orderBy("year")).alias("next_year"))
    both = once.withColumn("next_here", inside).alias("e").join(
        later.alias("y"), F.expr(" and ".join(f"e.{k} <=> y.{k}" for k in [*keys, "year"])), "left"
    )
    return both.filter("e.action = 'add'").select(
        *[F.col(f"e.{k}") for k in keys], F.col("e.dated").alias("valid_from"), F.coalesce("e.next_here", "y.next_year").alias("valid_to")
    )


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: its columns, n_active, verdict, pattern and list_name.

    ``captures`` have url and fetched_at; ``entries`` have list_name, kind (block or allow),
    pattern, action (add or remove) and dated.  The longest active pattern decides, and allow
    before block; ``verdict`` is block, allow or none.  A capture without a url, host or time
    has no active entries.  Repeated captures are judged once and each get the verdict.

    Intervals are cut at the turn of years and joined on pattern and year.  The join leaves
    at most one entry per list, kind and pattern of a capture, and its large keys can be split.
    """
    spans = stage(validity(entries), "list-intervals")
    asked = captures.filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).select("url", "fetched_at")
    once = asked.groupBy("url", "fetched_at").agg(F.count("*").alias("n"))
    last = F.year(F.coalesce("valid_to", F.lit(captures.agg(F.max("fetched_at")).first()[0])))
    years = F.sequence(F.year("valid_from"), F.greatest(last, F.year("valid_from")))
    by_year = spans.withColumn("in_year", F.explode(years))
    keyed = once.select("url", "fetched_at", F.year("fetched_at").alias("in_year"), F.explode(F.array_distinct(url_keys("url"))).alias("pattern"))
    active = keyed.join(by_year, ["pattern", "in_year"]).filter(
        (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    rank = F.struct(F.length("pattern").alias("long"), (F.col("kind") == "allow").alias("allows"), F.col("pattern"), F.col("list_name"))
    judged = active.groupBy("url", "fetched_at").agg(F.count("*").alias("n_active"), F.max(rank).alias("best"))
    own_url, own_time = free_name(captures, "_url"), free_name(captures, "_at")
    judged = judged.select(
        F.col("url").alias(own_url), F.col("fetched_at").alias(own_time), "n_active",
        F.when(F.col("best.allows"), "allow").otherwise("block").alias("verdict"), "best.pattern", "best.list_name",
    )
    names = [name for name in captures.columns if name not in ("n_active", "verdict", "pattern", "list_name")]
    out = captures.select(*names).join(judged, (F.col("url") == F.col(own_url)) & (F.col("fetched_at") == F.col(own_time)), "left")
    return out.select(*names, F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"), F.coalesce("verdict", F.lit("none")).alias("verdict"), "pattern", "list_name")
