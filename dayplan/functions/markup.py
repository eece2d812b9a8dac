"""Light message markup (bold, italic, list lines) as column expressions.

Bold spans are found first, italic spans only between them.  No span crosses a line
break, so each line is read on its own.  A line is a list line if what remains
outside its spans starts with a dash or star and white space; the marker is removed
from the first stretch of text that starts with one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup patterns.  (?d) makes "." stop at a line feed only, and
# white space is spelled out because Java's \s knows ASCII only.
SPACE = (
    r"[ \t\n\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
BOLD = r"(?d)\*\*(.*?)\*\*"
ITALIC = r"(?d)\*(.*?)\*"
LIST_MARKER = rf"^{SPACE}*[-*]{SPACE}+"


def parsed_lines(text: Column) -> Column:
    """One struct per line: ``shown`` text, ``bold`` and ``italic`` counts, ``item`` flag."""

    def parse(line: Column) -> Column:
        pieces = F.split(line, BOLD, -1)
        bold = F.regexp_extract_all(line, F.lit(BOLD), 1)
        texts = F.flatten(F.transform(pieces, lambda piece: F.split(piece, ITALIC, -1)))
        italics = F.transform(pieces, lambda piece: F.regexp_extract_all(piece, F.lit(ITALIC), 1))
        spans = F.flatten(
            F.zip_with(
                italics,
                bold,
                lambda within, after: F.when(after.isNull(), within).otherwise(
                    F.concat(within, F.array(after))
                ),
            )
        )
        return F.struct(
            texts.alias("texts"),
            spans.alias("spans"),
            F.size(bold).alias("bold"),
            F.aggregate(italics, F.lit(0), lambda n, found: n + F.size(found)).alias("italic"),
            F.rlike(F.array_join(texts, ""), F.lit(LIST_MARKER)).alias("item"),
        )

    def show(line: Column) -> Column:
        marked = F.transform(line["texts"], lambda part: F.rlike(part, F.lit(LIST_MARKER)))
        first = F.when(line["item"], F.array_position(marked, True)).otherwise(F.lit(0))
        bare = F.transform(
            line["texts"],
            lambda part, at: F.when(
                at + 1 == first, F.regexp_replace(part, LIST_MARKER, "")
            ).otherwise(part),
        )
        shown = F.zip_with(
            bare, line["spans"], lambda part, span: F.concat(part, F.coalesce(span, F.lit("")))
        )
        return F.struct(
            F.array_join(shown, "").alias("shown"),
            line["bold"].alias("bold"),
            line["italic"].alias("italic"),
            line["item"].alias("item"),
        )

    return F.transform(F.transform(F.split(text, "\n", -1), parse), show)
