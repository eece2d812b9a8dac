"""Rounding and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: From here on a double has no digits behind the point.
WHOLE = float(1 << 52)
#: Fixed value: splits a double into two halves of 26 bits.
SPLITTER = float((1 << 27) + 1)


def half_even(column: Column, places: int = 2) -> Column:
    """The double nearest to the decimal number of ``places`` that is nearest to the value.

    The value is what the double holds exactly: 2.675 lies a little below the tie and gives
    2.67, where ``bround`` rounds its shortest decimal form and gives 2.68.  Ties, such as
    0.125, go to the even digit.  The scaled value is kept as a product and its rounding error,
    which is exact, so that the comparison with the tie is.
    """
    value, scale = column.cast("double"), float(10**places)
    scaled = value * scale
    high = value * SPLITTER - (value * SPLITTER - value)
    error = (high * scale - scaled) + (value - high) * scale
    whole = F.floor(scaled).cast("double")
    over = (scaled - whole) - 0.5
    odd = F.pmod(whole, F.lit(2.0)) == 1
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & odd)))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(scaled) < WHOLE, rounded).otherwise(value)


def half_even_scaled(column: Column, places: int = 2) -> Column:
    """The scaled double rounded to a whole number and scaled back, as array libraries round.

    Differs from ``half_even`` where scaling itself rounds to a tie: 2.675 gives 2.68.
    """
    scale = float(10**places)
    value = column.cast("double")
    return F.when(F.abs(value * scale) < WHOLE, F.rint(value * scale) / scale).otherwise(value)


def stored_whole(column: Column) -> Column:
    """A forecast as it is stored: rounded to two places, then cut toward zero."""
    return half_even(column).cast("bigint")


def stable_uuid(text: Column, space: str = "") -> Column:
    """A uuid-shaped id that depends only on ``text`` and on the name space it is from, so a
    rerun gives the same ids, and an old id and a name that look alike give different ones."""
    digest = F.md5(F.concat(F.lit(space), text.cast("string")))
    pieces = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in pieces])


def shown_name(display_name: Column, username: Column) -> Column:
    """The display name, or the user name where it is NULL or empty."""
    return F.coalesce(F.nullif(display_name, F.lit("")), username)
