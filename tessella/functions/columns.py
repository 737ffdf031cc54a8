"""Helpers for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """The same value, worked out once a row: the optimizer neither repeats it in what uses it nor moves a filter on it below."""
    return F.when(F.monotonically_increasing_id() >= 0, value)
