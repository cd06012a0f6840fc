"""Training scalars: tables of (step, tag, value) to wide, smoothed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_values(scalars: DataFrame, step: str = "step", tag: str = "tag", value: str = "value", order: str = "ordinal") -> DataFrame:
    """S9. The last value of each step and tag."""
    return scalars.groupBy(step, tag).agg(F.max_by(value, order).alias(value))


def wide(scalars: DataFrame, tags: Sequence[str], step: str = "step", tag: str = "tag", value: str = "value", order: str = "ordinal") -> DataFrame:
    """W14. A row for each step with a column for each tag; naming the tags spares a pass over the data."""
    return scalars.groupBy(step).pivot(tag, list(tags)).agg(F.max_by(value, order))


def smooth(table: DataFrame, columns: Sequence[str], window: int, step: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """W10. Trailing means over ``window`` rows, fewer at the start."""
    rows = Window.partitionBy(*by).orderBy(step).rowsBetween(-(window - 1), 0)
    return table.withColumns({c: F.avg(c).over(rows) for c in columns})
