"""The queries of problems 1, 2, 3, 6, 7 and 8."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..storage import small_or_plain, write_table
from . import bpe, neardup, packing, qdigest, reading, topn
from .sql import ORACLE as ORACLE
from .timings import latest_delivery, valid_ms

# ---------------------------------------------------------------- 1: percentiles

PERCENTILES = {"p50": (50, 100), "p90": (90, 100), "p95": (95, 100), "p99": (99, 100)}


def timing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, grp, day, ms of all measurements that hold and are valid."""
    parts = []
    for metric, name, grp in (("function", "function_timings", "lang_family"), ("file", "file_timings", "lang_family"), ("phase", "phase_timings", "phase")):
        held = latest_delivery(table(spark, sf_dir, name), "timing_id", "received_at", ["ms", "measured_at", grp])
        group = F.col(grp) if metric != "phase" else F.lower(F.trim(F.regexp_replace(grp, r"^\s+|\s+$", "")))
        parts.append(held.where(valid_ms() & F.col("measured_at").isNotNull()).select(F.lit(metric).alias("metric"), group.alias("grp"), F.to_date("measured_at").alias("day"), "ms"))
    return reduce(DataFrame.unionByName, parts)


def weekly_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest per metric, group and week, merged from those of the days."""
    days = qdigest.digests(timing_values(spark, sf_dir), ["metric", "grp", "day"], "ms")
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week_start")
    return qdigest.merge(days.select("metric", "grp", week, "digest"), ["metric", "grp", "week_start"])


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain bounds of the percentiles of each group and week."""
    return qdigest.quantile_bounds(weekly_digests(spark, sf_dir), ["metric", "grp", "week_start"], PERCENTILES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with at least 30 values whose 95th percentile is 8 times the median or more.

    The digests decide all groups whose bounds leave no doubt; only for the
    others the exact percentiles are taken.
    """
    keys = ["metric", "grp", "week_start"]
    digest = weekly_digests(spark, sf_dir)
    seen = write_table(qdigest.quantile_bounds(digest, keys, {q: PERCENTILES[q] for q in ("p50", "p95")}).where("n_values >= 30"), "bounds")
    # 8 times a median may pass the range of bigint
    eight = lambda c: F.col(c).cast("decimal(38,0)") * 8
    sure = seen.where(F.col("p95_low") >= eight("p50_high")).select(*keys)
    open_ = seen.where((F.col("p95_low") < eight("p50_high")) & (F.col("p95_high") >= eight("p50_low"))).select(*keys)
    if not open_.take(1):
        return sure
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week_start")
    values = timing_values(spark, sf_dir).select("metric", "grp", week, "ms")
    left, right = values.alias("v"), open_.alias("o")
    hit = left.join(right, [F.col(f"v.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_semi")
    exact = qdigest.exact_quantiles(hit, keys, "ms", {q: PERCENTILES[q] for q in ("p50", "p95")})
    return sure.unionByName(exact.where(F.col("p95") >= eight("p50")).select(*keys))


# ---------------------------------------------------------------- 2: near duplicates


def _alike_families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast("array<string>")
    sources = F.concat(F.coalesce(F.col("positives.source"), none), F.coalesce(F.col("negatives.source"), none))
    return neardup.near_duplicates(table(spark, sf_dir, "families"), "fam_no", sources, n=3, num=3, den=5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of families whose sets of token 3-grams have at least 0.6 of their union in common."""
    pairs, members = _alike_families(spark, sf_dir)
    return neardup.expand(pairs, members).select(F.col("a").alias("fam_a"), F.col("b").alias("fam_b"))


def p2_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family with a set, the first family with an equal one, and the number of families it is alike to."""
    pairs, members = _alike_families(spark, sf_dir)
    first = members.groupBy("cls").agg(F.min("id").alias("class_fam"))
    return neardup.links(pairs, members).join(first, "cls").select(F.col("id").alias("fam_no"), "class_fam", "n_links")


# ---------------------------------------------------------------- 3: top items


def slow_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements that can be among a file's slowest, written once."""
    held = latest_delivery(table(spark, sf_dir, "function_timings"), "timing_id", "received_at", ["ms", "file", "func"])
    return write_table(held.where(valid_ms() & (F.col("file") != "") & F.col("func").isNotNull()).select("file", "func", "ms", "timing_id"), "timings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five slowest measurements of every file."""
    return topn.top_n(slow_functions(spark, sf_dir), "file", "ms", [F.col("func"), F.col("timing_id")], 5).select("file", "rnk", "timing_id")


# ---------------------------------------------------------------- 6: token ids

#: The vocabulary file of the queries (public; see the README).
VOCABULARY = os.environ.get("WEIRFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, without special tokens."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)


# ---------------------------------------------------------------- 7: containers


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    sizes = write_table(bpe.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "containers"))


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container, container_no, doc_id, piece, start, size (in tokens) for every document and kind of container."""
    return _packed(spark, sf_dir)[0]


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used of each kind, and the least number that the tokens need."""
    rows, _ = _packed(spark, sf_dir)
    capacity = table(spark, sf_dir, "containers").select("container", "capacity")
    per = rows.groupBy("container", "container_no").agg(F.sum("size").alias("used"))
    used = per.groupBy("container").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return used.join(small_or_plain(capacity, packing.MAX_KINDS), "container").select(
        "container", "capacity", "containers", "tokens", "fullest", F.expr("(tokens + capacity - 1) div capacity").alias("least")
    )


# ---------------------------------------------------------------- 8: reading level

#: Words of prose from which on a document is judged.
MIN_WORDS = 60


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every English document; above 0 it asks for more than 12 years of schooling."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return reading.reading_levels(docs, "doc_id", "text", table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where((F.col("n_words") >= MIN_WORDS) & (F.col("level") > 0)).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_percentiles": p1_percentiles, "p2_found": p2_found, "p2_families": p2_families, "p3_found": p3_found, "p6_ids": p6_ids, "p7_assignments": p7_assignments, "p7_usage": p7_usage, "p8_found": p8_found, "p8_levels": p8_levels}
