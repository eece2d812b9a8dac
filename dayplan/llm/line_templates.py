"""Line deduplication by a log-template tree (operator 7).

A line goes down a tree of fixed depth: its token count, then its leading tokens, where a
token with a digit counts as a variable field.  The lines of a leaf are grouped by the tokens
they agree in, and each group has a template, in which positions without a majority token are
variable too.  Lines whose template recurs in enough different texts are page furniture, and
are dropped from every document; long lines that recur in fewer texts stay in one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.llm.common import SPACES
from dayplan.sources.staging import stage

LEADING = 3
#: Different texts in which a template recurs.
MIN_TEXTS = 10
#: Lines of so many tokens recur from so many different texts on.
LONG_TOKENS, LONG_TEXTS = 20, 2
#: Share of a leaf's lines that makes a token constant, and of a line's tokens that must equal constants.
MAJORITY, ALIKE = 0.6, 0.6
FIELD = "<*>"
#: Pieces of a line after its leading tokens; lines are grouped by the tokens of each set of pieces.
PIECES = 4
#: Lines are also grouped by their tokens that occur in the leaf LEVEL ** k times as often as a template must.
LEVEL, LEVELS = 8, 6
#: Parts into which the lines of a leaf, or the texts of a line, are dealt for a join.
PARTS = 8
#: The white space of SPACES that a line can hold.
BLANKS = " \t\x0b\x0c\r"


def plain(line: Column) -> Column:
    """The line with single blanks and none at its ends."""
    odd = line.startswith(" ") | line.endswith(" ")
    for blanks in ("  ", *BLANKS[1:]):
        odd = odd | line.contains(blanks)
    return F.when(odd, F.btrim(F.regexp_replace(line, f"[{SPACES}]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """The plain line with a mark for each token that has a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def part(texts: str) -> Column:
    return F.pmod(F.col(texts), F.lit(PARTS)).alias("part")


def in_parts(rows: DataFrame) -> DataFrame:
    """Every row once for each part, to be joined by merging at any size."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))).hint("merge")


def with_leaves(docs: DataFrame) -> DataFrame:
    """One row per line with a token: doc_id, text_hash, ``at`` (its place among the lines), the masked
    ``line``, its ``hash``, its ``leaf`` in the tree, and whether it is ``long``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("at", "line"))
    rows = rows.filter(F.btrim("line", F.lit(BLANKS)) != "")
    rows = rows.withColumn("line", plain(F.col("line"))).withColumn("line", masked(F.col("line")))
    rows = rows.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    leaf = F.xxhash64("n", F.substring_index("line", " ", LEADING)).alias("leaf")
    return rows.select("doc_id", "text_hash", "at", F.xxhash64("line").alias("hash"), leaf, (F.col("n") >= LONG_TOKENS).alias("long"), "line")


def group_keys(variants: DataFrame) -> DataFrame:
    """``(g, hash, n_texts, need)``: the groups of each line ``(hash, leaf, line, n_texts, need)`` in its leaf.

    One group for each set of pieces, of the lines with equal tokens in all of its pieces (the
    empty set is the whole leaf), and one for each level, of the lines with equal frequent
    tokens.  So templates that share a leaf part, unless all pieces have fields and their
    values are as frequent as the template.  The leading tokens are the leaf's and part nothing.
    """
    own = variants.withColumn("own", F.split("line", " ", -1)).withColumn("m", F.greatest(F.size("own") - LEADING, F.lit(0)))
    tokens = own.select("hash", "leaf", "n_texts", "need", F.posexplode(F.slice("own", F.lit(LEADING + 1), F.col("m"))).alias("at", "token"))
    cells = tokens.select("hash", "n_texts", "need", F.xxhash64("leaf", "at", "token").alias("cell"))
    frequent = cells.groupBy("cell").agg(F.sum("n_texts").alias("n"), F.max("need").alias("least")).filter("n >= least")
    often = cells.select("hash", "cell").join(frequent.select("cell", "n").hint("merge"), "cell")
    often = often.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("often"))
    start = lambda k: F.ceil(F.col("m") * k / PIECES).cast("int")
    rows = own.join(often.hint("merge"), "hash", "left")
    for k in range(PIECES):
        rows = rows.withColumn(f"p{k}", F.xxhash64(F.slice("own", start(k) + LEADING + 1, start(k + 1) - start(k))))

    def pieces(chosen: int) -> Column:
        return F.xxhash64(F.lit(chosen), *[F.col(f"p{k}") for k in range(PIECES) if chosen >> k & 1])

    def level(k: int) -> Column:
        kept = F.filter("often", lambda x: x.n >= F.col("need") * LEVEL**k)
        return F.xxhash64(F.lit(-1), F.transform(kept, lambda x: x.cell))

    keys = F.array(*[pieces(chosen) for chosen in range(2**PIECES - 1)], *[level(k) for k in range(LEVELS)])
    keyed = rows.select("leaf", "hash", "n_texts", "need", F.explode(F.array_distinct(keys)).alias("key"))
    return keyed.select(F.xxhash64("leaf", "key").alias("g"), "hash", "n_texts", "need")


def line_groups(variants: DataFrame) -> DataFrame:
    """``(g, hash, all)`` of the groups that can recur, each set of lines once; ``all`` sums its n_texts.

    A line that is alone in its leaf is in no group.
    """
    several = variants.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select("leaf")
    variants = variants.withColumn("part", part("hash")).join(in_parts(several), ["leaf", "part"]).drop("part")
    keyed = stage(group_keys(stage(variants, "lines-in-company")), "line-group-keys")
    members = keyed.groupBy("g").agg(
        F.sum("n_texts").alias("all"), F.max("need").alias("need"), F.count("*").alias("n"), F.bit_xor("hash").alias("mark")
    )
    members = members.filter("n > 1 and all >= need").groupBy("n", "mark").agg(F.min("g").alias("g"), F.max("all").alias("all"))
    return keyed.select("g", "hash").join(members.select("g", "all").hint("merge"), "g")


def group_templates(grouped: DataFrame) -> DataFrame:
    """``(g, template)`` from the different lines ``(g, line, n_texts, all)`` of each group.

    A group in which no token has the majority has no row.  Tokens are counted by group and position with map-side combine; only the tokens of one
    template, as many as its lines have, come together.
    """
    own = grouped.select("g", "n_texts", "all", F.split("line", " ", -1).alias("own")).withColumn("size", F.size("own"))
    tokens = own.select("g", "n_texts", "all", "size", F.posexplode("own").alias("at", "token"))
    counts = tokens.groupBy("g", "at", "token").agg(F.sum("n_texts").alias("n"), F.max("all").alias("all"), F.max("size").alias("size"))
    placed = counts.filter(F.col("n") >= MAJORITY * F.col("all")).groupBy("g", "size").agg(F.collect_list(F.struct("at", "token")).alias("constants"))
    others = F.array_except(F.sequence(F.lit(0), F.col("size") - 1), F.transform("constants", lambda x: x.at))
    fields = F.transform(others, lambda i: F.struct(i.alias("at"), F.lit(FIELD).alias("token")))
    ordered = F.sort_array(F.concat("constants", fields))
    return placed.select("g", F.transform(ordered, lambda x: x.token).alias("template"))


def recurring_lines(lines: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``(hash, template, keeper)`` of the masked lines whose template recurs in ``min_texts`` texts.

    ``lines`` are those of ``with_leaves``.  Copies of one text count once.  A line that recurs by itself counts as a template even
    where its groups' templates are others'.  Long lines recur from LONG_TEXTS texts on; where they are in less than
    ``min_texts``, ``keeper`` is the hash of the text that keeps its line.
    """
    need = F.when(F.col("long"), F.lit(min(LONG_TEXTS, min_texts))).otherwise(F.lit(min_texts))
    by_leaf = lines.select("leaf", "long", "text_hash").distinct().groupBy("leaf", "long").agg(F.count("*").alias("n"))
    busy = stage(by_leaf.filter(F.col("n") >= need).select("leaf", need.alias("need")), "busy-leaves")
    busy_lines = lines.select("text_hash", "hash", "leaf", "line", part("text_hash")).join(in_parts(busy), ["leaf", "part"])
    busy_lines = stage(busy_lines.drop("part").distinct(), "busy-lines")
    variants = busy_lines.groupBy("hash", "leaf", "line", "need").agg(F.count("*").alias("n_texts"), F.min("text_hash").alias("first"))
    variants = stage(variants, "line-variants")
    grouped = stage(line_groups(variants).join(variants.select("hash", "line", "need", "n_texts").hint("merge"), "hash"), "line-groups")
    same = F.size(F.filter(F.arrays_zip("template", F.split("line", " ", -1).alias("own")), lambda x: x.template == x.own))
    fields = F.size(F.filter("template", lambda t: t == FIELD))
    templates = stage(group_templates(grouped), "group-templates")
    matched = grouped.join(templates.hint("merge"), "g")
    matched = matched.filter((fields < F.size("template")) & (same >= ALIKE * F.size("template")))
    matched = stage(matched.select("g", "hash", "need", F.array_join("template", " ").alias("template")), "matched-lines")
    texts = busy_lines.select("hash", "text_hash").join(matched.select("hash", "g", "need").hint("merge"), "hash")
    texts = texts.select("g", "need", "text_hash").distinct()
    texts = texts.groupBy("g", "need").agg(F.count("*").alias("n"), F.min("text_hash").alias("first"))
    keeper = lambda n: F.when(F.col(n) < min_texts, F.col("first")).alias("keeper")
    often = texts.filter("n >= need").select("g", keeper("n"))
    general = matched.join(often.hint("merge"), "g").select("hash", "template", "keeper")
    alone = variants.filter("n_texts >= need").select("hash", F.col("line").alias("template"), keeper("n_texts"))
    kept_once = F.when(F.count("keeper") == F.count("*"), F.min("keeper")).alias("keeper")
    return general.unionByName(alone).groupBy("hash").agg(F.min("template").alias("template"), kept_once)


def without_templates(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """One row per document: doc_id, text without recurring lines, n_lines and n_dropped.

    ``n_lines`` counts lines with a token.  Lines without one stay where they are, but for a
    text of which nothing else is left, which becomes empty.  A missing text is an empty one.
    Very long texts and lines are taken whole; time grows in proportion to their lines.  Rows
    are cleaned one by one, so repeated rows or ids do not matter.  Of two tokens that share a
    place of a template equally often, none has a majority.  An empty table gives an empty one,
    and other columns of ``docs`` are not looked at.
    """
    lines = stage(with_leaves(docs), "template-lines")
    dropped = stage(recurring_lines(lines, min_texts).select("hash", "keeper"), "recurring-lines")
    hits = lines.select("doc_id", "text_hash", "hash", "at", part("text_hash")).join(in_parts(dropped), ["hash", "part"])
    hits = hits.filter("keeper is null or keeper != text_hash")
    hits = hits.groupBy(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_text")).agg(F.collect_set("at").alias("_hits"))
    hits = stage(hits, "dropped-by-document").hint("merge")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("_text_hash"))
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_hit_id"]) & (rows["_text_hash"] == hits["_hit_text"]), "left")
    hit = F.col("_hits").isNotNull()
    rows = rows.withColumn("_split", F.when(hit, F.split("text", "\n", -1)))
    rows = rows.withColumn("_places", F.when(hit, F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_hits")))
    rows = rows.withColumn("_rest", F.array_join(F.transform("_places", lambda i: F.get("_split", i)), "\n"))
    return rows.select(
        "doc_id",
        F.when(~hit, F.col("text")).when(F.col("_rest").rlike(f"[^{SPACES}]"), F.col("_rest")).otherwise(F.lit("")).alias("text"),
        F.regexp_count("text", F.lit(f"[^{SPACES}][^\\n]*")).cast("bigint").alias("n_lines"),
        F.when(hit, F.size("_hits")).otherwise(0).cast("bigint").alias("n_dropped"),
    )
