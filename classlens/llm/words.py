"""Column expressions for the words of a text: maximal runs outside ``\\x20\\x09-\\x0D``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words; empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")
