"""Values that must not be computed twice.

Spark copies the definition of a column into every later expression and filter that uses it. That is
free for plain column arithmetic, but a chain of patterns over a long text would run again for each use.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(value: Column) -> Column:
    """The text itself, null where it is empty; the value is computed once."""
    return let(value, lambda x: F.nullif(x, F.lit("")))


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds or replaces columns whose definitions stay where they are.

    The columns come from a one-row generator: later filters and projections read its output, and
    filters on other columns still move below it.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))
