"""Plan shape helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinned(column: Column | str) -> Column:
    """The column itself, computed once where it stands in the plan.

    A filter on a computed column is normally pushed below the projection by repeating the expression there.  Screening
    columns are built step on step, so repeating them grows with the power of the number of steps, and every pattern
    would run again for the filter.  The optimizer leaves a column alone that reads the partition id; the test itself
    is always true and costs nothing.  Unused columns are still pruned.
    """
    return F.when(F.spark_partition_id() >= 0, F.col(column) if isinstance(column, str) else column)


def text_literal(text: str) -> str:
    """SQL literal of a text.

    Rule tables are turned into one SQL expression per detector instead of a Column call per rule: building a plan of
    a few thousand Column calls takes seconds, parsing the same expression takes milliseconds.
    """
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def map_literal(table: dict[str, object]) -> str:
    """SQL map of a small table."""
    pairs = (f"{text_literal(k)}, {text_literal(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"map({', '.join(pairs)})"
