"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain column reference may be inlined by the optimizer into a lambda,
    where it would be evaluated again for every element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
