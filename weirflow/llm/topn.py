"""The N highest-scoring items of every group, with one tie rule for all.

Every group's scores are counted per bucket of an ordered universe
(``qdigest.leaf`` with a short mantissa). The highest bucket at or above which at
least N rows of the group lie is a safe threshold: no row below it can be among
the N. Rows below it are dropped before anything is ranked; what is left is
ranked exactly by score and tie keys.

A histogram is one row per group and bucket, combined in each task, so a group
of a third of all rows is as light as any (there are at most 64 * 2**BUCKET_BITS
buckets). Thresholds are one row a group: up to a checked size they are broadcast
to the rows, so these are dropped where they are read; beyond it rows and
thresholds meet in a join on the group, of which AQE splits large partitions.
In both cases each task cuts its rows to the first N of a group before the
ranking shuffles them (the group limit of a window with a rank filter), which
also holds where millions of rows tie in the threshold's bucket.

Defined cases: rows with a null group, score or tie key must be filtered
before if they are not to count (null tie keys come first in ascending order; a
null group is a group of its own, whose rows are all ranked); repeated rows are
ranked one after the other; columns of any name are kept, one named like the
rank is replaced; groups with fewer than N rows keep all; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_plain, write_table
from .qdigest import leaf

#: Four buckets to a power of two.
BUCKET_BITS = 2
#: Groups up to which their thresholds are broadcast (and 64 MB, see ``small_or_plain``).
MAX_BROADCAST_GROUPS = 1_000_000


def thresholds(df: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """For each group of ``n`` rows or more the lowest bucket that must be kept: group, _least."""
    counts = df.select(F.col(group), leaf(F.col(score), BUCKET_BITS).alias("_bucket")).groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(group).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_above", above).where(F.col("_above") >= n).groupBy(group).agg(F.max("_bucket").alias("_least"))


def survivors(df: DataFrame, group: str, score: str, n: int) -> DataFrame:
    """The rows at or above their group's threshold; all rows of groups without one."""
    least = "_least"
    while least in df.columns:
        least += "_"
    lowest = write_table(thresholds(df.select(F.col(group).alias("_g"), F.col(score).alias("_s")), "_g", "_s", n), "thresholds")
    lowest = small_or_plain(lowest.select(F.col("_g").alias(group), F.col("_least").alias(least)), MAX_BROADCAST_GROUPS)
    return df.join(lowest, group, "left").where(F.col(least).isNull() | (leaf(F.col(score), BUCKET_BITS) >= F.col(least))).drop(least)


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[Column], n: int, rank: str = "rnk") -> DataFrame:
    """The first ``n`` rows of each group by score descending, then ``ties``; ``rank`` from 1.

    ``score`` is a number of [0, 2**63). ``df`` is read twice (histograms,
    ranking), so give a written table or a scan.
    """
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    return survivors(df, group, score, n).withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
