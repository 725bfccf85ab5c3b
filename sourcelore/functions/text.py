"""Column expressions over whole file texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import COMPLEXITY


def size_units(content: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.floor(F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("bigint")


def line_count(content: Column) -> Column:
    """Newlines plus one: an empty file has one line, a final newline opens another."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def complexity(content: Column) -> Column:
    """One plus every branching word or operator in the raw text, comments included."""
    return (F.regexp_count(content, F.lit(COMPLEXITY)) + 1).cast("bigint")


def complexity_label(value: Column) -> Column:
    return F.when(value > 10, "High").when(value > 5, "Medium").otherwise("Low")
