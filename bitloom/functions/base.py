"""Helpers of column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row.

    A column that a lambda over an array refers to is otherwise computed again for each element once projections collapse.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    """Sum of an array of doubles, from the first to the last."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
