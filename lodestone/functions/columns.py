"""Building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once; a column that an expression names several times is computed, and planned, as often."""
    return F.transform(F.array(value), then)[0]
