"""Text to DATE with day-first preference, as column expressions.

A text is tidied, cut free of a time of day, and its parts are classed: ``Y`` a number of four
digits, ``D`` one of at most two, ``M`` a word.  The order of the classes decides what the
parts mean.  Everything is built from foldable functions, so a literal text becomes a literal
date before planning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months, full and short, in English and Spanish.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
# Words read relative to ``as_of``, with their distance in days.
RELATIVE_WORDS = {
    "yesterday": -1, "today": 0, "tomorrow": 1, "ayer": -1, "hoy": 0, "mañana": 1,
    "anteayer": -2, "pasado mañana": 2,
}
# Words that say nothing, and the days of the week.
FILLERS = "of|the|de|del|el"
WEEKDAYS = (
    "monday|tuesday|wednesday|thursday|friday|saturday|sunday|"
    "lunes|martes|miércoles|miercoles|jueves|viernes|sábado|sabado|domingo"
)
# Units of an offset in days and in months.
UNITS = {
    "days?|d[ií]as?": (1, 0),
    "weeks?|semanas?": (7, 0),
    "months?|mes(?:es)?": (0, 1),
    "years?|años?": (0, 12),
}
TIME = r"[ t]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[ap]\.?m\.?)?( ?(z|utc|gmt|[+-]\d{2}:?\d{2}))?$"
NUMBER = r"(?<![0-9]){}(?![0-9])"
#: Orders of parts with a month by name; a part that is missing takes the first day or the year of ``as_of``.
NAMED_SHAPES = ["M", "M Y", "Y M", "D M", "M D", "D M Y", "M D Y", "Y M D", "Y D M"]


def date_of(year: Column, month: Column, day: Column) -> Column:
    """NULL where there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def numeric_date(tidy: Column) -> Column:
    """Three numbers: the year first, or day, month, year; a month beyond 12 can only be the day."""
    ahead, behind = r"^(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})$", r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})$"
    part = lambda pattern, group: F.regexp_extract(tidy, pattern, group)
    first, second, year = part(behind, 1), part(behind, 2), part(behind, 3)
    swapped = second.try_cast("int") > 12
    return F.when(tidy.rlike(ahead), date_of(part(ahead, 1), part(ahead, 2), part(ahead, 3))).when(
        tidy.rlike(behind),
        date_of(year, F.when(swapped, first).otherwise(second), F.when(swapped, second).otherwise(first)),
    )


def named_date(tidy: Column, as_of: Column | None) -> Column:
    """A month by name with a day, a year, both or neither, in any usual order."""
    bare = F.regexp_replace(tidy, r"(\d)(st|nd|rd|th|º|ª|°)\b", "$1")
    bare = F.regexp_replace(bare, r"[,.]", " ")
    bare = F.regexp_replace(bare, rf"(?<!\pL)({FILLERS}|{WEEKDAYS})(?!\pL)", " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    shape = F.regexp_replace(bare, r"\pL+", "M")
    shape = F.regexp_replace(shape, NUMBER.format("[0-9]{4}"), "Y")
    shape = F.regexp_replace(shape, NUMBER.format("[0-9]{1,2}"), "D")
    numbers = F.create_map(*[F.lit(value) for pair in MONTHS.items() for value in pair])
    month = F.try_element_at(numbers, F.regexp_extract(bare, r"\pL+", 0)).cast("string")
    day = F.regexp_extract(bare, NUMBER.format("[0-9]{1,2}"), 0)
    year = F.regexp_extract(bare, NUMBER.format("[0-9]{4}"), 0)
    this_year = F.lit(None).cast("string") if as_of is None else F.year(as_of).cast("string")
    found = F.when(year == "", this_year).otherwise(year)
    whole = shape.isin(NAMED_SHAPES) & month.isNotNull() & found.isNotNull()
    return F.when(whole, date_of(found, month, F.when(day == "", "1").otherwise(day)))


def relative_date(tidy: Column, as_of: Column) -> Column:
    """Words such as yesterday, and offsets such as ``in 3 days`` or ``hace 2 semanas``."""
    out = F.lit(None).cast("date")
    for units, (days, months) in UNITS.items():
        for sign, pattern in ((1, rf"^(?:in|en|dentro de) (\d{{1,4}}) (?:{units})$"),
                              (-1, rf"^(?:hace )?(\d{{1,4}}) (?:{units}) ago$|^hace (\d{{1,4}}) (?:{units})$")):
            count = F.regexp_extract(tidy, r"\d+", 0).try_cast("int") * sign
            moved = F.add_months(as_of, count * months) if months else F.date_add(as_of, count * days)
            out = F.when(tidy.rlike(pattern), moved).otherwise(out)
    for word, shift in RELATIVE_WORDS.items():
        out = F.when(tidy == word, F.date_add(as_of, shift)).otherwise(out)
    return out


def normalize_date(text: Column, as_of: str | dt.date | Column | None = None) -> Column:
    """DATE for the ways in which people write days.

    Numbers with ``-``, ``/`` or ``.`` (year first, else day first), months by name in English
    or Spanish with or without day and year (``July 2024``, ``April 1st 2024``, ``5 de enero de
    2024``), any of these with a time of day, and words and offsets relative to ``as_of``.  A
    missing day is the first of the month, a missing year that of ``as_of``.  Without
    ``as_of`` what needs one gives NULL, as does anything that is not a date.
    """
    tidy = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    tidy = F.regexp_replace(tidy, TIME, "")
    day = None if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    found = [numeric_date(tidy), named_date(tidy, day)]
    if day is not None:
        found.append(relative_date(tidy, day))
    return F.coalesce(*found)


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
