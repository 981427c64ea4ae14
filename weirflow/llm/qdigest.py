"""Mergeable percentiles with a guaranteed rank error, by dyadic-tree digests.

Values of [0, 2**63) are quantised to an ordered universe of 2**HEIGHT leaves:
below 2**MANTISSA each value has its own leaf, above that each power of two is
cut into 2**MANTISSA leaves, so a leaf is at most 2**-MANTISSA of its values
wide. A digest holds counts on nodes of the complete binary tree over the
leaves (node 1 is the root, leaf i is node 2**HEIGHT + i). Siblings whose counts
and their parent's together are at most n // k are folded into the parent, so
an inner node never holds more than n // k and a rank read off the digest is
wrong by at most HEIGHT * (n // k).

Digests of parts (days, partitions, sources) are merged by adding node counts
and folding again; the bound holds for the merged n. ``bounds`` gives for each
quantile the interval in which the exact value lies for certain.

The rows are counted per leaf before any shuffle, so a group with a third of
all rows shuffles at most 2**HEIGHT counts a task, and no task or driver ever
holds a group's values.

Defined cases: null, negative and too large values must be filtered first
(``timings.valid_ms``); a group without values has no digest; null group keys
form a group; an empty table gives no digests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_table

MANTISSA = 8
#: 2**14 leaves: one block below 2**MANTISSA and one for each of the powers 8..62.
HEIGHT = 14
K = 2000

_NODES = "array<struct<node:int,n:bigint>>"


def leaf(value: Column, mantissa: int = MANTISSA) -> Column:
    """The leaf of a value, computed in the JVM."""
    v = value.cast("bigint")
    guess = F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int")
    # the logarithm of a double can be one off next to a power of two
    shift = lambda a, b: F.call_function("shiftright", a, b)
    e = guess + F.when(shift(v, guess) == 0, -1).when(shift(v, guess) >= 2, 1).otherwise(0)
    e = F.when(v < 2**mantissa, mantissa).otherwise(e).cast("int")
    return F.when(v < 2**mantissa, v).otherwise((e - mantissa) * 2**mantissa + shift(v, e - F.lit(mantissa))).cast("int")


def leaf_range(leaves: np.ndarray, mantissa: int = MANTISSA) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of each leaf; those beyond the last used one count as it."""
    leaves = np.minimum(np.asarray(leaves, dtype=np.int64), ((63 - mantissa + 1) << mantissa) - 1)
    block = np.maximum((leaves >> mantissa) - 1, 0)
    mant = leaves - (block << mantissa)
    low = mant << block
    return low, low + ((np.int64(1) << block) - 1)


def fold(nodes: np.ndarray, counts: np.ndarray, k: int = K, height: int = HEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Add up equal nodes and fold light siblings into their parents, level by level."""
    size = 1 << (height + 1)
    tree = np.zeros(size, dtype=np.int64)
    np.add.at(tree, nodes, counts)
    limit = int(tree.sum()) // k
    if limit:
        for level in range(height, 0, -1):
            first = 1 << level
            kids = tree[first : 2 * first].reshape(-1, 2)
            parents = tree[first >> 1 : first]
            total = kids.sum(axis=1) + parents
            light = (kids.sum(axis=1) > 0) & (total <= limit)
            parents[light] = total[light]
            kids[light] = 0
    held = np.flatnonzero(tree)
    return held.astype(np.int32), tree[held]


def bounds(nodes: np.ndarray, counts: np.ndarray, quantiles: Sequence[tuple[int, int]], height: int = HEIGHT) -> list[tuple[int, int]]:
    """For each quantile (a fraction as two integers) the certain bounds of its value.

    The quantile is the smallest value with a share of at least q at or below it.
    """
    nodes = np.asarray(nodes, dtype=np.int64)
    counts = np.asarray(counts, dtype=np.int64)
    depth = np.floor(np.log2(nodes)).astype(np.int64)
    span = height - depth
    first = (nodes << span) - (1 << height)
    last = first + (np.int64(1) << span) - 1
    by_first, by_last = np.argsort(first, kind="stable"), np.argsort(last, kind="stable")
    most, least = np.cumsum(counts[by_first]), np.cumsum(counts[by_last])
    n = int(counts.sum())
    out = []
    for num, den in quantiles:
        rank = max(1, -(-num * n // den))
        low = first[by_first][np.searchsorted(most, rank)]
        high = last[by_last][np.searchsorted(least, rank)]
        out.append((int(leaf_range(low)[0]), int(leaf_range(high)[1])))
    return out


def _folded(counted: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Digest per group of rows (keys, _node, _times); a group has at most 2**(HEIGHT + 1) of them."""

    @F.pandas_udf(_NODES)
    def to_digest(cells: pd.Series) -> pd.Series:
        def one(x: list) -> list:
            nodes, counts = fold(np.array([c["node"] for c in x], dtype=np.int64), np.array([c["n"] for c in x], dtype=np.int64), k)
            return [{"node": int(a), "n": int(b)} for a, b in zip(nodes, counts, strict=True)]

        return cells.map(one)

    cell = F.struct(F.col("_node").alias("node"), F.col("_times").alias("n"))
    gathered = counted.groupBy(*keys).agg(F.sum("_times").alias("n_values"), F.collect_list(cell).alias("_cells"))
    return gathered.select(*keys, "n_values", to_digest("_cells").alias("digest"))


def digests(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """keys, n_values and the digest of ``value`` for each group."""
    counted = df.groupBy(*keys, (leaf(F.col(value)) + F.lit(1 << HEIGHT)).alias("_node")).agg(F.count(F.lit(1)).alias("_times"))
    return _folded(counted, keys, k)


def merge(parts: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Digests of parts to digests per ``keys``: node counts add up, then fold."""
    nodes = parts.select(*keys, F.explode("digest").alias("_c")).groupBy(*keys, F.col("_c.node").alias("_node")).agg(F.sum("_c.n").alias("_times"))
    return _folded(nodes, keys, k)


def quantile_bounds(digest: DataFrame, keys: Sequence[str], quantiles: dict[str, tuple[int, int]]) -> DataFrame:
    """keys, n_values and for each named quantile its certain bounds <name>_low and <name>_high."""
    names = list(quantiles)
    kind = "struct<" + ",".join(f"{n}_low:bigint,{n}_high:bigint" for n in names) + ">"

    @F.pandas_udf(kind)
    def read(cells: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in cells:
            rows = []
            for x in part:
                found = bounds(np.array([c["node"] for c in x]), np.array([c["n"] for c in x]), list(quantiles.values()))
                rows.append([v for pair in found for v in pair])
            yield pd.DataFrame(rows, columns=[f"{n}_{s}" for n in names for s in ("low", "high")], dtype="int64")

    return digest.select(*keys, "n_values", read("digest").alias("_q")).select(*keys, "n_values", "_q.*")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, tuple[int, int]]) -> DataFrame:
    """Exact quantiles by radix descent, for the few groups that bounds leave open.

    The distinct values of a group are written once with their counts; four
    passes of 16 bits then read them: each counts the next digit of the values that share
    the prefix found so far, so a group is never held as a whole: a pass keeps
    at most 2**16 counts a group. Result: keys and one column per quantile.
    """
    bits, digits = 16, 4
    shift = lambda a, b: F.call_function("shiftright", a, F.lit(b))
    rows = write_table(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a"), F.lit(b).alias("b")) for q, (a, b) in quantiles.items()]))
    state = rows.groupBy(*keys).agg(F.sum("_n").alias("_total")).select(*keys, asked.alias("_q"), "_total")
    state = state.select(*keys, F.col("_q.q").alias("_name"), F.greatest(F.lit(1), F.expr("(_q.a * _total + _q.b - 1) div _q.b")).cast("bigint").alias("_rank"), F.lit(0).cast("bigint").alias("_prefix"))
    for d in range(digits - 1, -1, -1):
        on = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
        same = shift(F.col("r._v"), bits * (d + 1)) == F.col("s._prefix") if d < digits - 1 else F.lit(True)
        hit = rows.alias("r").join(state.alias("s"), on=[*on, same])
        counts = hit.groupBy(*[F.col(f"s.{c}").alias(c) for c in keys], F.col("s._name").alias("_name"), F.col("s._rank").alias("_rank"), F.col("s._prefix").alias("_prefix"), shift(F.col("r._v"), bits * d).alias("_digit")).agg(F.sum("r._n").alias("_n"))
        w = Window.partitionBy(*keys, "_name").orderBy("_digit")
        upto = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        state = upto.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).select(
            *keys, "_name", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"), F.col("_digit").alias("_prefix")
        )
    return state.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == q, F.col("_prefix"))).alias(q) for q in quantiles])
