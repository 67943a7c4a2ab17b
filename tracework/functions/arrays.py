"""Column expressions over arrays of doubles; all stay in the JVM.

Catalyst evaluates what stands inside a lambda once an element, and it may move
an earlier column's expression into one. ``let`` binds a value to a lambda
variable instead, so sums, medians and sorted arrays are computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    """NULL for an empty array."""
    return let(values, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def _spread(v: Column, centre: Column, ddof: int) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre))
    return F.when(F.size(v) > ddof, squares / (F.size(v) - ddof))


def variance(values: Column, ddof: int = 0) -> Column:
    """Two-pass variance; NULL where fewer than ddof + 1 values are there."""
    return let(values, lambda v: let(mean(v), lambda m: _spread(v, m, ddof)))


def std(values: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(values, ddof))


def median(values: Column) -> Column:
    """Exact median of the array."""
    middle = lambda s, n: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, middle(s, F.size(s))))


def tail(values: Column, n: int) -> Column:
    """The last n values, or all of a shorter array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """0-based place of the largest value, the first of equals; NULL for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)).cast("int") - 1)
