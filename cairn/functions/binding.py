"""Evaluate an expression once and refer to the result by name.

Catalyst substitutes a projected expression into every place that uses it when
it pushes filters down.  For large expressions used many times that multiplies
the plan and repeats the work; these two helpers keep them single.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)


def computed(df: DataFrame, record: Column) -> DataFrame:
    """Add the fields of a struct as columns that later filters refer to but never re-evaluate."""
    return df.select("*", F.inline(F.array(record)))
