"""Joins that are not plain equalities, as plans of hash and sort-merge joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_table


def wildcard_pairs(stores: DataFrame, loads: DataFrame, keys: Sequence[str], field: str, store_id: str, load_id: str) -> DataFrame:
    """Stores and loads of equal keys whose fields are equal or '*' (JOIN-04).

    The OR of three conditions would be a nested loop over a key's rows; a union
    of an equal join and of the two wildcard sides keeps hash joins.
    """
    s, ld = stores.select(*keys, field, store_id), loads.select(*keys, field, load_id)
    out = [store_id, load_id]
    exact = s.join(ld, [*keys, field]).select(*out)
    left = s.where(F.col(field) == "*").drop(field).join(ld.where(F.col(field) != "*"), list(keys)).select(*out)
    right = s.where(F.col(field) != "*").join(ld.where(F.col(field) == "*").drop(field), list(keys)).select(*out)
    return exact.unionByName(left).unionByName(right).distinct()


def nearest_before(rows: DataFrame, marks: Column, scope: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Each row with the value of the nearest earlier marked row of its scope (JOIN-06).

    One window instead of an inequality join: the scope is read once.
    """
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(marks, F.col(value)), ignorenulls=True).over(w))


def in_ranges(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, low: str, high: str, bin_width: int) -> DataFrame:
    """Rows whose point lies in a range of the same key (JOIN-17), by binned equality.

    Ranges are listed in every bin they touch, so give a width near their usual
    length; a row matches once, however many ranges hold it.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / bin_width), F.floor(F.col(high) / bin_width))).alias("_bin")
    r = ranges.where(F.col(low) <= F.col(high)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(low).alias("_low"), F.col(high).alias("_high"), bins)
    on = F.floor(F.col(point) / bin_width) == F.col("_bin")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(r, on & F.col(point).between(F.col("_low"), F.col("_high")), "left_semi")


def band(rows: DataFrame, others: DataFrame, keys: Sequence[str], at: str, width: int, how: str = "left_semi") -> DataFrame:
    """Rows with (left_semi) or without (left_anti) another within ``width`` of the same key (JOIN-18)."""
    near = F.explode(F.array(*[(F.floor(F.col(at) / width) + d) for d in (-1, 0, 1)])).alias("_bin")
    o = others.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"), near).distinct()
    on = (F.floor(F.col(at) / width) == F.col("_bin")) & (F.abs(F.col(at) - F.col("_at")) <= width)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(o, on, how)


def def_use(defs: DataFrame, uses: DataFrame, keys: Sequence[str], use: str) -> DataFrame:
    """Definitions (one row per key, as in SSA form) with the number of their uses; unused ones have none (JOIN-01)."""
    n = uses.groupBy(*keys).agg(F.count(use).alias("n_uses"))
    return defs.join(n, list(keys), "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))


def sibling_pairs(rows: DataFrame, site: Sequence[str], item: str) -> DataFrame:
    """site..., a, b: different items of one site, each pair once (JOIN-05).

    For sites of few items by their nature, as the arguments of a call are.
    """
    one = rows.select(*site, item).distinct()
    return one.withColumnRenamed(item, "a").join(one.withColumnRenamed(item, "b"), list(site)).where("a < b")


def resolve_aliases(calls: DataFrame, aliases: DataFrame, symbol: str, target: str) -> DataFrame:
    """Calls with the target their symbol stands for; a symbol without an alias is its own (JOIN-10)."""
    a = aliases.select(F.col(symbol), F.col(target).alias("_target")).dropDuplicates([symbol])
    return calls.join(a, symbol, "left").withColumn(target, F.coalesce("_target", symbol)).drop("_target")


def follow_links(start: DataFrame, links: DataFrame, name: str, max_hops: int = 12) -> DataFrame:
    """``start`` with ``name`` followed along links (name, next) to its end, and the hops taken (JOIN-09).

    Of several links of a name the least counts. After ``max_hops`` a name is
    taken as it then is, and ``hops`` says so; cycles end there too.
    """
    one = write_table(links.where(F.col(name).isNotNull() & F.col("next").isNotNull() & (F.col(name) != F.col("next"))).groupBy(name).agg(F.min("next").alias("_next")), "links")
    at = start.withColumn("hops", F.lit(0))
    done = []
    for _ in range(max_hops):
        step = write_table(at.join(one, name, "left"), "follow")
        done.append(step.where("_next is null").drop("_next"))
        open_ = step.where("_next is not null")
        if open_.isEmpty():
            break
        at = open_.withColumn(name, F.col("_next")).withColumn("hops", F.col("hops") + 1).drop("_next")
    else:
        done.append(at)
    return reduce(DataFrame.unionByName, done)


def new_since(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Findings that the baseline does not have, each once (JOIN-15)."""
    return current.join(baseline.select(key), key, "left_anti").dropDuplicates([key])


def with_fallback(calls: DataFrame, exact: DataFrame, bare: DataFrame, exact_key: str, bare_key: str, value: str) -> DataFrame:
    """The exact target of a call, else that of its bare name (JOIN-02)."""
    e = exact.select(F.col(exact_key), F.col(value).alias("_exact"))
    b = bare.select(F.col(bare_key), F.col(value).alias("_bare"))
    return calls.join(e, exact_key, "left").join(b, bare_key, "left").withColumn(value, F.coalesce("_exact", "_bare")).drop("_exact", "_bare")


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result only, with the side they are of (AGG-20)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
