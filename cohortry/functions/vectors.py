"""Fixed-width array arithmetic, unrolled so it stays inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def items(vector, width: int) -> list[Column]:
    v = col(vector)
    return [v[i] for i in range(width)]


def total(terms) -> Column:
    return reduce(add, terms)


def floats(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def clip(c: Column, low, high) -> Column:
    """Clip that keeps null and passes NaN through to the upper bound as Spark orders it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def argmax_first(vector) -> Column:
    """Zero-based position of the largest entry; the first wins ties."""
    v = col(vector)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and named, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def normalised(terms: list[Column], *, flat: bool = False) -> Column:
    """Array of the terms divided by their sum (floored at 1e-12).

    ``flat`` unrolls cheap terms into generated code; otherwise the terms are bound once, so nesting stays linear.
    """
    floor = F.lit(1e-12)
    if flat:
        s = F.greatest(total(terms), floor)
        return F.array(*[t / s for t in terms])
    return bind(F.array(*terms), lambda a: bind(F.greatest(total(items(a, len(terms))), floor), lambda s: F.transform(a, lambda v: v / s)))


def entry(vector, index: Column) -> Column:
    """Entry at a zero-based column index; null outside the array."""
    return F.try_element_at(col(vector), index.cast("int") + 1)


def softmax(scores: list[Column]) -> Column:
    shifted = lambda a: bind(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(v - top)))
    return bind(bind(F.array(*scores), shifted), lambda e: normalised(items(e, len(scores))))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
