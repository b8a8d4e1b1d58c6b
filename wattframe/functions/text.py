"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text) -> Column:
    """Trim any white space at both ends and lower-case."""
    return F.lower(F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", ""))


def contains_word(text, alternatives: str) -> Column:
    """True where one of the ``a|b|c`` alternatives occurs between word bounds.

    ``(?U)`` makes ``\\b`` follow Unicode, so an accented letter next to a
    keyword counts as part of the word.
    """
    return _col(text).rlike(rf"(?U)\b({alternatives})\b")


def hour_of_text(time_text) -> Column:
    """Hour from ``HH:MM:SS`` text; malformed text gives null."""
    return F.split(_col(time_text), ":")[0].try_cast("int")
