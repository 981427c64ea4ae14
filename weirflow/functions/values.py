"""Intervals, three-valued comparison and rates (FN-11..14, FN-38).

An interval is two bigint columns (low, high). Arithmetic saturates at the
ends of bigint: corners are taken in DECIMAL(38, 0), as plain bigint products
would raise under ANSI rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(2**63), 2**63 - 1
_BIG = "decimal(38,0)"


def saturate(c: Column) -> Column:
    """A decimal clamped to bigint."""
    return F.greatest(F.least(c.cast(_BIG), F.lit(HIGH).cast(_BIG)), F.lit(LOW).cast(_BIG)).cast("bigint")


def _corners(values: list[Column]) -> tuple[Column, Column]:
    return saturate(F.least(*values)), saturate(F.greatest(*values))


def add(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    (al, ah), (bl, bh) = [[x.cast(_BIG) for x in i] for i in (a, b)]
    return saturate(al + bl), saturate(ah + bh)


def sub(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    (al, ah), (bl, bh) = [[x.cast(_BIG) for x in i] for i in (a, b)]
    return saturate(al - bh), saturate(ah - bl)


def mul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    # halves of the decimal range: two bigint factors give 38 digits at most
    x, y = [c.cast("decimal(19,0)") for c in a], [c.cast("decimal(19,0)") for c in b]
    return _corners([(p * q).cast(_BIG) for p in x for q in y])


def shift_left(a: tuple[Column, Column], bits: Column) -> tuple[Column, Column]:
    factor = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(bits, F.lit(62)))).cast("bigint")
    return mul(a, (factor, factor))


def compare(op: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """true, false or null (unknown) for <, <=, >, >=, ==, != of two intervals."""
    (al, ah), (bl, bh) = a, b
    if op == "<":
        return F.when(ah < bl, True).when(al >= bh, False)
    if op == "<=":
        return F.when(ah <= bl, True).when(al > bh, False)
    if op in (">", ">="):
        return compare("<" if op == ">" else "<=", b, a)
    same = F.when((al == ah) & (bl == bh) & (al == bl), True).when((ah < bl) | (bh < al), False)
    return same if op == "==" else ~same


def hull(low: str | Column, high: str | Column) -> tuple[Column, Column]:
    """Aggregates for the join of a group's intervals."""
    return F.min(low), F.max(high)


def intersect(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The common part; ``a`` is kept if there is none."""
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return F.when(low <= high, low).otherwise(a[0]), F.when(low <= high, high).otherwise(a[1])


def rate(part: Column, rest: Column, digits: int = 3) -> Column:
    """part / (part + rest), 0 where both are 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), part + rest), F.lit(0.0)), digits)
