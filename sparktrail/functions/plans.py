"""Helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above the expensive columns of ``df``.

    The optimizer pushes a filter through projections by substituting their
    expressions. For columns built from parsed JSON in several steps that means
    parsing again for each use, and again for each step: plans grow
    exponentially. Generator outputs are not substituted, so the columns pass
    through a generator that yields exactly the row it gets.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
