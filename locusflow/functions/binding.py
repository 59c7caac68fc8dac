"""Binding an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it.

    Written without it, every use repeats the whole sub-expression, and nesting
    multiplies the repeats.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
