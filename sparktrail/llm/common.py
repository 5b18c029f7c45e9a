"""Small shared helpers: ASCII lower-casing, keys, and reading the input tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whitespace of the contracts, and the words between it.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in; others are translated."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def pieces(text: Column, gap: str) -> Column:
    """What lies between matches of the pattern ``gap``, without empty pieces; null text has none.

    Several times as fast as extracting the pieces by the opposite pattern.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap, -1), "")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that extra ones (and clashing names) never reach an operator."""
    return df.select(*columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(text: Column) -> Column:
    """Tells rows apart that share an id but not a text. Null and empty differ."""
    return F.xxhash64(text, text.isNull())


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit
