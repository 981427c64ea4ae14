"""Timing measurements as they hold: the latest delivery of each, valid durations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A duration must be below this value (fixed).
MAX_MS = 9223372036854775807


def latest_delivery(df: DataFrame, key: str, received: str, columns: Sequence[str]) -> DataFrame:
    """For each ``key`` the row with the greatest ``received``.

    Deliveries received at the same time: the greatest of the other columns in
    their order, nulls last. A null ``received`` is older than any other. Rows
    without a key cannot repeat one another and all stay. Repeated keys are
    reduced before the shuffle, however many there are of one.
    """
    names = [key, *columns]
    held = F.max(F.struct(received, *columns)).alias("_held")
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(held).select(key, *[F.col(f"_held.{c}").alias(c) for c in columns])
    return known.unionByName(df.where(F.col(key).isNull()).select(*names))


def valid_ms(ms: str = "ms") -> Column:
    """Whether ``ms`` is a duration: not null, not negative, below the fixed bound."""
    return F.col(ms).isNotNull() & (F.col(ms) >= 0) & (F.col(ms) < F.lit(MAX_MS))
