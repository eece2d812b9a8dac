"""Quality rules with cross-document line frequencies (operator 8).

All of it is SQL functions.  Counts of the base rules and the hashes of normalised lines are
written to a narrow table, and what follows (documents per line and host, words in frequent
lines per document) only reads that table.  The texts are read once more to take the frequent
lines out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.llm.common import SPACES, free_name
from dayplan.sources.staging import stage

REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is frequent on a host if more different texts of it have the line, whatever its size.
LINE_DOCS = 20
#: A document is depleted if less of its words remains without the frequent lines.
KEPT_SHARE = 0.3

SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: str) -> Column:
    trimmed = F.btrim(F.col(text), F.lit(SPACE_CHARACTERS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, f"[{SPACES}]+", -1))


def repeated_windows(windows: str) -> Column:
    """(hash, place) of the windows in order of hash, if any hash repeats; else nothing.

    ``windows`` holds the 64-bit hash of each window of a text.
    """
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(pairs))


def repeated_words(pairs: str) -> Column:
    """Words inside windows that occur twice or more, first occurrences included.

    Pairs beside an equal hash are the repeated windows.  In order of place, each adds what
    lies between it and the place before it, and a whole window at most.
    """
    places = F.expr(f"""
        sort_array(transform(filter(
            transform({pairs}, (p, i) -> struct(p.place as place,
                p.hash = get({pairs}, i - 1).hash or p.hash = get({pairs}, i + 1).hash as twice)),
            q -> q.twice), q -> q.place))""")
    step = lambda acc, place: F.struct(
        (acc.n + F.least(F.lit(REPEAT_WINDOW), place - acc.last)).cast("bigint").alias("n"), place.cast("bigint").alias("last")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-REPEAT_WINDOW).cast("bigint").alias("last"))
    covered = F.aggregate(places, start, step, lambda acc: acc.n)
    return F.when(F.col(pairs).isNull(), F.lit(0).cast("bigint")).otherwise(covered)


def squeezed(line: Column) -> Column:
    """The line without white space and with 0 for every digit."""
    return F.translate(line, "123456789" + SPACE_CHARACTERS, "0" * 9)


def line_hash(host: Column, line: Column) -> Column:
    """What stands for a squeezed line of a host."""
    return F.xxhash64(host, F.lower(line))


def signals(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: the counts of the base rules and its lines.

    A line is normalised to lower case, without white space, and with 0 for every digit.
    ``lines`` has each line with a word: its hash together with the host, and its characters
    without white space.  A missing text has no words or lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = f"size(w) - {REPEAT_WINDOW}"
    parts = ", ".join(f"get(w, i + {k})" for k in range(REPEAT_WINDOW))
    windows = f"if({last} < 0, cast(array() as array<bigint>), transform(sequence(0, {last}), i -> xxhash64({parts})))"
    filled = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    hashed = lambda line: F.struct(
        line_hash(F.col("source"), line).alias("line"), F.length(line).cast("bigint").alias("n")
    )
    rows = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text")
        )
        .withColumn("w", words("text"))
        .withColumn("windows", F.expr(windows))
        .withColumn("pairs", repeated_windows("windows"))
        .withColumn("filled", filled)
        .withColumn("squeezed", F.transform("filled", squeezed))
    )
    zero = F.lit(0).cast("bigint")
    counted = rows.select(
        "doc_id",
        "source",
        F.xxhash64("source").alias("host"),
        F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("squeezed", zero, lambda n, line: n + F.length(line)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("bigint").alias("n_dup_lines"),
        repeated_words("pairs").alias("n_repeat_words"),
        F.transform("squeezed", hashed).alias("lines"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    few = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", few)


def frequent_lines(staged: DataFrame, line_docs: int, line_share: float = 0.0) -> DataFrame:
    """Hashes of the lines that too many different texts of their host have.

    A caller can ask for a share of the host's texts besides; by default size plays no part.

    Copies of one text on a host count once, so that copies do not make a text's own
    lines look like page furniture.
    """
    lines = staged.select("host", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line")).distinct()
    by_line = lines.groupBy("line").agg(F.count("*").alias("n_docs"), F.min("host").alias("host"))
    common = by_line.filter(F.col("n_docs") > line_docs)
    if not line_share:
        return common.select("line")
    by_host = staged.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return common.join(by_host, "host").filter(F.col("n_docs") > line_share * F.col("host_docs")).select("line")


def judged(docs: DataFrame, line_docs: int, line_share: float, kept_share: float) -> DataFrame:
    """The rows of ``judge`` with ``hits``, the hashes of the document's frequent lines, if any."""
    staged = stage(signals(docs), "quality-signals")
    frequent = stage(frequent_lines(staged, line_docs, line_share), "frequent-lines")
    lines = staged.select("row_id", F.explode("lines").alias("at"))
    lines = lines.select("row_id", F.col("at.line").alias("line"), F.col("at.n").alias("n"))
    removed = lines.join(frequent, "line").groupBy("row_id").agg(F.sum("n").alias("n_removed"), F.collect_set("line").alias("hits"))
    kept_chars = F.col("word_chars") - F.coalesce("n_removed", F.lit(0))
    depleted = kept_chars < kept_share * F.col("word_chars")
    return staged.join(removed, "row_id", "left").select(
        *["doc_id", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        "base_failed",
        kept_chars.cast("bigint").alias("n_kept_chars"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
        "hits",
    )


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = 0.0, kept_share: float = KEPT_SHARE
) -> DataFrame:
    """One row per document with the base counts, ``n_kept_chars`` and the verdict ``kept``.

    A document fails if a base rule fails, or if less than ``kept_share`` of its characters
    (white space aside) remains without the lines that are frequent on its host.  The host is
    ``source``; documents without one are a host together.  Repeated rows are judged one by
    one, alike.
    """
    return judged(docs, line_docs, line_share, kept_share).drop("hits")


def with_verdicts(docs: DataFrame, verdicts: DataFrame, how: str) -> tuple[DataFrame, Column, str]:
    """``docs`` beside the rows of ``judged`` that are about them in one column, the text without
    its frequent lines, and the name of the column.

    Verdict and lines depend on text and host alone; the rows are found again by doc_id,
    source and a hash of the text.
    """
    v = free_name(docs, "verdict")
    keys = ["doc_id", "source", "text_hash"]
    about = verdicts.dropDuplicates(keys).select(F.struct(*verdicts.columns).alias(v))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = docs["doc_id"].eqNullSafe(F.col(f"{v}.doc_id")) & docs["source"].eqNullSafe(F.col(f"{v}.source"))
    # Verdicts grow with the corpus: joined by shuffle at every size.
    rows = docs.join(about.hint("merge"), same & (F.xxhash64(text) == F.col(f"{v}.text_hash")), how)
    host = docs["source"].cast("string")
    filled = lambda line: line.rlike(f"[^{SPACES}]")
    goes = lambda line: filled(line) & F.array_contains(F.col(f"{v}.hits"), line_hash(host, squeezed(line)))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~goes(line)), "\n")
    return rows, F.when(F.col(f"{v}.hits").isNull(), docs["text"]).otherwise(left), v


def judge_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``judge`` with ``text``, the document's text without the lines that are
    frequent on its host, whether it is kept or not; a missing text is an empty one."""
    verdicts = stage(judged(docs, LINE_DOCS, 0.0, KEPT_SHARE), "quality-verdicts")
    rows, text, v = with_verdicts(docs, verdicts, "inner")
    return rows.select(f"{v}.*", F.coalesce(text.cast("string"), F.lit("")).alias("text")).drop("hits")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, and without the lines
    that are frequent on their host; ``n_chars``, if there is one, follows a changed text."""
    found = judged(docs, LINE_DOCS, 0.0, KEPT_SHARE).filter("not kept or hits is not null")
    rows, text, v = with_verdicts(docs, found, "left")
    rows = rows.filter(F.coalesce(F.col(f"{v}.kept"), F.lit(True)))
    changed = F.col(f"{v}.hits").isNotNull()
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(text.alias(name))
        elif name == "n_chars":
            kind = docs.schema[name].dataType
            columns.append(F.when(changed, F.length(text).cast(kind)).otherwise(docs[name]).alias(name))
        else:
            columns.append(docs[name])
    return rows.select(*columns)
