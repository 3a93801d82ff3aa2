"""Column helpers shared by the operators that use built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import let, scan

__all__ = ["let", "scan", "total", "words_of"]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
