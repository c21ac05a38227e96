"""Evaluate once, use many times inside a lambda."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    A lambda body recomputes every outer expression for each element; passing the value
    in as a lambda variable keeps array expressions linear.
    """
    return F.transform(F.array(value), use)[0]
