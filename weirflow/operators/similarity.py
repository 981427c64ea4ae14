"""Text sets that are alike, within the JVM (JOIN-20, MIN-11, FN-28, FN-29).

Sets are arrays of hashed shingles. Records with equal sets form a class whose
least id stands for it. A class' prefix in rare-first order (exact document
frequencies) must share a shingle with that of any class alike; such pairs pass
a length filter and are verified once on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table


def shingle_sets(df: DataFrame, key: str, words: Column, n: int, scope: str | None = None) -> DataFrame:
    """id, scope and the sorted set of hashed shingles; records without words have none and are left out."""
    toks = df.select(F.col(key).alias("id"), (F.col(scope) if scope else F.lit("")).alias("scope"), words.alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))
    alone = F.transform("w", lambda t: F.xxhash64(F.array(t)))
    return toks.select("id", "scope", F.array_sort(F.array_distinct(F.when(F.size("w") < n, alone).otherwise(runs))).alias("s"))


def alike(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, cls) and pairs of classes (a, b) of one scope with Jaccard of at least num / den."""
    keyed = write_table(sets.withColumn("k", F.xxhash64("scope", "s")), "sets")
    cls = keyed.groupBy("k").agg(F.min("id").alias("cls"))
    members = write_table(keyed.select("id", "k").join(cls, "k").select("id", "cls"), "members")
    reps = write_table(keyed.join(members.where("id = cls").select("id"), "id", "left_semi").select("id", "scope", "s", F.size("s").alias("n")), "sets")
    grams = reps.select("id", "scope", "n", F.explode("s").alias("g"))
    df = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # shingles of one record only can match nothing, but still take their place in the order
    ordered = grams.join(df, "g").groupBy("id", "scope", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    length = (F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1).cast("int")
    prefix = ordered.select("id", "scope", "n", F.explode(F.slice("o", F.lit(1), length)).alias("p")).where("p.df > 1").select("id", "scope", "n", F.col("p.g").alias("g"))
    a, b = prefix.alias("a"), prefix.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    first = (na < nb) | ((na == nb) & (F.col("a.id") < F.col("b.id")))
    pairs = (
        a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.scope") == F.col("b.scope")))
        .where(first & (na * den >= nb * num))
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    )
    x, y = reps.select(F.col("id").alias("a"), F.col("s").alias("x")), reps.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    kept = both.where(common * den >= (F.size("x") + F.size("y") - common) * num).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return members, kept


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: id, cls and the number of records it is alike to, copies among them."""
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    far = ends.join(size.toDF("other", "far"), "other").groupBy("cls").agg(F.sum("far").alias("far"))
    return members.join(size, "cls").join(far, "cls", "left").select("id", "cls", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
