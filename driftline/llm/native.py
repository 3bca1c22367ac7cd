"""Column expressions that the native operators share: what a pattern finds, the text between, and the text put together again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(pattern: str) -> Column:
    return F.lit(pattern)


def found_in(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the n + 1 texts around these n."""
    return F.regexp_extract_all(text, quoted(pattern), F.lit(0)), F.split(text, pattern, -1)


def rebuilt(gaps: Column, values: Column) -> Column:
    """gaps[0] values[0] gaps[1] ... gaps[n]"""
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.concat(g, v)), ""), F.element_at(gaps, -1))
