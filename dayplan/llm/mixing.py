"""Mixing sources to target weights by a hypergeometric splitting tree (operator 2).

The documents of a source are put in a random but repeatable order and cut into blocks of
words.  How many blocks of each source the mixture draws is exact.  A binary tree then deals
these quotas to the output shards: each node passes half of its blocks to the left, and how
many of them come from each source is a multivariate hypergeometric draw, as if the node's
blocks had been shuffled.  Shards therefore have exact quotas that follow the mixture, and
draw disjoint runs of each source's permuted blocks; inside a shard blocks and documents are
shuffled.  All of it is SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dayplan.llm.common import SPACES, free_name, n_words, running_start
from dayplan.sources.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 65_536
#: The tree has this many levels, and two to this power shards.
LEVELS = 4
SEED = 20_240_601
#: Pieces of a source in the running sum, by the first digits of a document's random key.
KEY_DIGITS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: rank, source_size, weight, target and drawn (whole words).

    Sources in order of code points, a missing one last, weigh 3, 1, 2 and so on.  A source
    that its share would take above twice its size stops there, and the others share what is
    left: in the order of size per weight, the first source that stays below sets the words
    per weight for all after it.  Only rows of sources, not of documents, meet in one task.
    """
    everything = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS))
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
    cap = (MOST_REPEATS * F.col("source_size")).cast("bigint")
    fill = W.orderBy(cap / F.col("weight"), "rank")
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rate = left / F.sum("weight").over(after)
    rated = ranked.select("*", cap.alias("cap"), rate.alias("rate"), F.row_number().over(fill).alias("turn"))
    below = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct("turn", "rate"))
    shared = F.min(below).over(everything).getField("rate")
    target = F.coalesce(F.least(F.col("cap").cast("double"), shared * F.col("weight")), F.lit(0.0))
    out = rated.select("source", "rank", "source_size", "weight", target.alias("target"))
    return out.withColumn("drawn", F.floor(F.col("target") + 0.5).cast("bigint"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def hypergeometric(items: Column, marked: Column, picks: Column, u: Column) -> Column:
    """How many of ``picks`` from ``items`` are among the ``marked``, for a uniform ``u``.

    Inverts the distribution function over its support, or where that is wide over twelve
    standard deviations and some to either side, outside of which no double can lead.
    """
    n, k, m = (c.cast("double") for c in (items, marked, picks))
    share = k / F.greatest(n, F.lit(1.0))
    mean = m * share
    spread = F.sqrt(F.greatest(mean * (1 - share) * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    reach = 12 * spread + 20
    low = F.greatest(F.lit(0).cast("bigint"), picks - (items - marked), F.floor(mean - reach).cast("bigint"))
    high = F.least(picks, marked, F.ceil(mean + reach).cast("bigint"))
    parts = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), u.alias("u"), low.alias("low"), high.alias("high"))

    def drawn(p: Column) -> Column:
        def next_weight(w: Column, x: Column) -> Column:
            return w * (p.k - x) * (p.m - x) / ((x + 1) * (p.n - p.k - p.m + x + 1))

        span = F.sequence(p.low, p.high)
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        add = lambda a, x: F.struct(next_weight(a.w, x).alias("w"), (a.sum + a.w).alias("sum"))
        total = F.aggregate(span, zero, add, lambda a: a.sum)

        def walk(all_weights: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), p.low.alias("at"))
            step = lambda a, x: F.struct(
                next_weight(a.w, x).alias("w"),
                (a.sum + a.w).alias("sum"),
                F.when(a.sum <= p.u * all_weights, x).otherwise(a.at).alias("at"),
            )
            return F.aggregate(span, start, step, lambda a: a.at)

        return let(total, walk)

    return let(parts, drawn)


def left_quotas(seed: int) -> Column:
    """The multivariate draw of a node: source after source, from what is left of both sides."""
    total = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, q: a + q)
    start = F.struct(
        total.alias("items"), F.floor(total / 2).cast("bigint").alias("picks"), F.array().cast("array<bigint>").alias("out")
    )

    def deal(acc: Column, i: Column) -> Column:
        mine = F.get("quota", i)
        bits = F.xxhash64(F.lit(seed), F.col("level"), F.col("shard"), i).bitwiseAND(F.lit((1 << 53) - 1))
        x = hypergeometric(acc.items, mine, acc.picks, bits.cast("double") / float(1 << 53))
        return let(
            x,
            lambda got: F.struct(
                (acc.items - mine).alias("items"), (acc.picks - got).alias("picks"), F.array_append(acc.out, got).alias("out")
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size("quota") - 1), start, deal, lambda acc: acc.out)


def shard_quotas(targets: DataFrame, block_words: int, levels: int, seed: int) -> DataFrame:
    """``(shard, rank, first, quota)``: each shard's run of a source's permuted blocks.

    A node of the tree is a row with one number per source.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "quota")))
    node = targets.agg(F.transform(ordered, lambda x: x.quota).alias("quota")).filter(F.size("quota") > 0)
    node = node.select(
        F.lit(0).alias("level"), F.lit(0).alias("shard"), "quota", F.transform("quota", lambda q: q - q).alias("first")
    )
    for level in range(levels):
        split = node.withColumn("left", left_quotas(seed))
        left = F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("quota"), F.col("first").alias("first"))
        right = F.struct(
            (2 * F.col("shard") + 1).alias("shard"),
            F.zip_with("quota", "left", lambda q, x: q - x).alias("quota"),
            F.zip_with("first", "left", lambda f, x: f + x).alias("first"),
        )
        node = split.select(F.lit(level + 1).alias("level"), F.explode(F.array(left, right)).alias("c")).select("level", "c.*")
    each = node.select("shard", F.posexplode(F.arrays_zip("quota", "first")).alias("rank", "x"))
    return each.select("shard", "rank", "x.first", "x.quota").filter("quota > 0")


def block_draws(targets: DataFrame, block_words: int, levels: int, seed: int) -> DataFrame:
    """``(rank, block, takes)``: for each time that a block is drawn its shard, its place in
    the shard, and the word of the source at which the mixture stops."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("drawn") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.col("drawn") - rounds * F.col("source_size")
    quota = (rounds * blocks + F.ceil(rest / block_words)).cast("bigint")
    counted = stage(targets.withColumn("blocks", blocks).withColumn("quota", quota), "mix-quotas")
    dealt = shard_quotas(counted.select("rank", "quota"), block_words, levels, seed)
    each = dealt.select("shard", "rank", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("draw"))
    drawn = each.join(counted.select("rank", "blocks", "source_size", "drawn"), "rank")
    epoch = F.floor(F.col("draw") / F.col("blocks")).cast("int")
    place = F.xxhash64(F.lit(seed), F.lit("place"), "rank", "draw")
    until = F.least(F.col("drawn") - epoch * F.col("source_size"), F.col("source_size"))
    take = F.struct(epoch.alias("epoch"), "shard", place.alias("place"), until.cast("bigint").alias("until"))
    draws = drawn.select("rank", (F.col("draw") % F.col("blocks")).cast("bigint").alias("block"), take.alias("take"))
    return draws.groupBy("rank", "block").agg(F.sort_array(F.collect_list("take")).alias("takes"))


def placed(
    docs: DataFrame, block_words: int = BLOCK_WORDS, levels: int = LEVELS, seed: int = SEED
) -> DataFrame:
    """``docs``, which have ``size``, with source_size, target, taken and ``takes``.

    A document belongs to the block with its first word.  ``takes`` has the shard, the place
    and the words of each time that the mixture takes it, from none to two; all its words but
    where the mixture reaches its target inside it.  ``taken`` is their sum.  Documents
    without words are never taken.  The order of documents hangs on doc_id alone; rows that
    share one follow each other.
    """
    targets = stage(source_targets(docs.select("source", "size")), "mix-targets")
    draws = stage(block_draws(targets, block_words, levels, seed), "mix-draws")
    source = free_name(docs, "_target_source")
    known = targets.select(F.col("source").alias(source), "rank", "source_size", "target")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.join(known, docs["source"].eqNullSafe(known[source])).drop(source).withColumn("_key", key)
    rows = rows.withColumn("_bucket", F.substring("_key", 1, KEY_DIGITS))
    rows = running_start(rows, ["rank"], "_bucket", ["_key", "size"], "size", "_start")
    rows = rows.withColumn("block", F.floor(F.col("_start") / block_words).cast("bigint"))
    rows = rows.join(draws, ["rank", "block"], "left")
    cut = lambda t: F.struct(
        t.epoch.alias("epoch"),
        t.shard.alias("shard"),
        t.place.alias("place"),
        F.greatest(F.least(t.until - F.col("_start"), F.col("size")), F.lit(0)).cast("bigint").alias("words"),
    )
    takes = F.filter(F.transform(F.coalesce("takes", F.array().cast("array<struct<epoch:int,shard:int,place:bigint,until:bigint>>")), cut), lambda t: t.words > 0)
    rows = rows.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda n, t: n + t.words)
    return rows.withColumn("taken", taken).select(*docs.columns, "source_size", "target", "taken", "takes")


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", n_words("text"))


def word_budget(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; texts are read once."""
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size")
    )
    rows = placed(stage(narrow, "document-sizes"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, **how: int) -> DataFrame:
    """The mixture itself: the columns of ``docs`` with ``shard`` and ``place``, a row for each
    time that a document is taken.

    Where the mixture stops inside a document, ``text`` ends after the words taken and
    ``n_chars``, if there is one, follows.  Sorted by (shard, place, _key of the document) the
    rows of a shard are shuffled.  Columns of ``docs`` that share a name with the
    operator's own are kept aside and come back.
    """
    own = [name for name in docs.columns if name not in ("doc_id", "source", "text")]
    held = docs.select("doc_id", "source", "text", F.struct(*own).alias("_held") if own else F.lit(None).alias("_held"))
    rows = placed(with_size(held), **how).select("doc_id", "source", "text", "_held", "size", F.explode("takes").alias("t"))
    parts = F.regexp_extract_all("text", F.lit(f"[{SPACES}]*[^{SPACES}]+"), F.lit(0))
    head = F.array_join(F.slice(parts, 1, F.col("t.words").cast("int")), "")
    whole = F.col("t.words") == F.col("size")
    columns = []
    for name in docs.columns:
        if name in ("doc_id", "source"):
            columns.append(F.col(name))
        elif name == "text":
            columns.append(F.when(whole, F.col("text")).otherwise(head).alias("text"))
        elif name == "n_chars":
            kept = F.col("_held.n_chars")
            columns.append(F.when(whole, kept).otherwise(F.length(head)).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"_held.`{name}`").alias(name))
    return rows.select(*columns, F.col("t.shard").alias(free_name(docs, "shard")), F.col("t.place").alias(free_name(docs, "place")))


def shuffled_shards(mixed: DataFrame, shard: str = "shard", place: str = "place", seed: int = SEED) -> DataFrame:
    """The rows of a mixture by shard, shuffled inside it: blocks by place, then documents."""
    order = F.xxhash64(F.lit(seed), "doc_id", place)
    return mixed.repartition(shard).sortWithinPartitions(shard, place, order)
