"""Deduplication, compaction, islands and ranked lookups (WIN-01..08, FLT-04, FLT-05, FCT-02, FCT-03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``; ties must be broken by it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_richest(df: DataFrame, keys: Sequence[str], richness: Column, order: Column) -> DataFrame:
    """The row with the most resolved steps per shape and place; the first of equal ones."""
    return first_per(df, keys, richness.desc(), order.asc())


def compact(df: DataFrame, scope: Sequence[str], order: Sequence[str], what: Sequence[str]) -> DataFrame:
    """Without rows that repeat the one before them in ``what``."""
    w = Window.partitionBy(*scope).orderBy(*order)
    same = F.lit(True)
    for c in what:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~same).where("_keep").drop("_keep")


def islands(df: DataFrame, scope: Sequence[str], low: str, high: str, gap: int = 1) -> DataFrame:
    """Overlapping and adjacent ranges merged: scope..., low, high."""
    w = Window.partitionBy(*scope).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*scope, low, high).withColumn("_new", F.when(F.coalesce(F.col(low) > reach + gap, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*scope, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def upsert_by_provenance(facts: DataFrame, keys: Sequence[str], provenance: str, seq: str) -> DataFrame:
    """The fact with the highest provenance per key; of equal ones the one that was there first."""
    return first_per(facts, keys, F.col(provenance).desc(), F.col(seq).asc())


def merge_layers(facts: DataFrame, keys: Sequence[str], layer: str, restricted: Column, seq: str) -> DataFrame:
    """Facts of several layers: a blanket one never widens a restricted one, otherwise the last wins."""
    return first_per(facts, keys, restricted.desc(), F.col(layer).desc(), F.col(seq).desc())


def longest_prefix(rows: DataFrame, prefixes: Column, facts: DataFrame, key: str, ident: Sequence[str]) -> DataFrame:
    """The fact with the longest of a row's prefixes; rows without one have nulls (FLT-04)."""
    asked = rows.select(*ident, F.posexplode(prefixes).alias("_pos", key))
    hit = first_per(asked.join(facts, key), ident, F.length(key).desc(), F.col("_pos"))
    return rows.join(hit.drop("_pos"), list(ident), "left")
