"""Small helpers on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(numbers: Column) -> Column:
    """Running sums of an array in O(n log n): each step adds the value 1, 2, 4, ... places before."""
    return let(numbers, lambda a: F.aggregate(
        F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(a)), a,
        lambda acc, d: F.transform(acc, lambda x, i: x + F.when(i >= d, acc[i - d]).otherwise(F.lit(0))),
    ))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
