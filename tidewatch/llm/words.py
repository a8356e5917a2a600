"""Words of a text as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are runs of anything but the space and the five ASCII control spaces.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """All words of a text in order; none for a missing text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)
