"""Scores of findings against ground truth (BEN-01..06, AGG-12, AGG-13, FN-38, JOIN-18, JOIN-21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import rate
from ..storage import small_or_plain
from .joins import band


def tag_weaknesses(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """id, cwe of each case from its findings' tags (BEN-02)."""
    return tags.select("id", F.explode("tag_sets").alias("t")).select("id", F.explode("t").alias("tag")).join(small_or_plain(mapping, 100_000), "tag").select("id", "cwe").distinct()


def classify(cases: DataFrame, results: DataFrame, named: DataFrame, mode: str = "conservative") -> DataFrame:
    """id, cwe, outcome: TP, FP, FN, TN or ERR (BEN-01).

    'any' takes any finding as a hit, 'cwe' one of the case's weakness, and
    'conservative' the latter for real cases but any for unreal ones.
    """
    own = named.select("id", "cwe").withColumn("_own", F.lit(True))
    r = results.select("id", "findings", "error")
    j = cases.join(r, "id", "left").join(own, ["id", "cwe"], "left")
    any_, same = F.coalesce(F.col("findings") > 0, F.lit(False)), F.coalesce("_own", F.lit(False))
    hit = {"any": any_, "cwe": same, "conservative": F.when(F.col("vulnerable"), same).otherwise(any_)}[mode]
    outcome = F.when(F.col("error").isNotNull() | F.col("findings").isNull(), "ERR").when(F.col("vulnerable"), F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))
    return j.select("id", "cwe", outcome.alias("outcome"))


def scorecard(outcomes: DataFrame, by: str = "cwe") -> DataFrame:
    """grp, counts of the five outcomes, tpr, fpr, score; the total as '(total)'."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o.lower())
    m = outcomes.rollup(by).agg(F.grouping(by).alias("_all"), *[n(o) for o in ("TP", "FP", "FN", "TN", "ERR")])
    tpr, fpr = rate(F.col("tp"), F.col("fn")), rate(F.col("fp"), F.col("tn"))
    grp = F.when(F.col("_all") == 1, "(total)").otherwise(F.coalesce(by, F.lit("(none)")))
    return m.select(grp.alias("grp"), "tp", "fp", "fn", "tn", "err", tpr.alias("tpr"), fpr.alias("fpr"), F.round(tpr - fpr, 3).alias("score"))


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Groups whose tpr fell or whose fpr rose by more than the tolerance (BEN-03)."""
    b = baseline.select("grp", F.col("tpr").alias("_tpr"), F.col("fpr").alias("_fpr"))
    j = now.join(b, "grp")
    return j.where((F.col("tpr") < F.col("_tpr") - tolerance) | (F.col("fpr") > F.col("_fpr") + tolerance)).select("grp", "tpr", F.col("_tpr").alias("tpr_before"), "fpr", F.col("_fpr").alias("fpr_before"))


def per_rule(results: DataFrame) -> DataFrame:
    """Per rule the cases it hits, each once, real and unreal ones apart (AGG-13)."""
    one = results.select("rule", "id", "vulnerable").distinct()
    return one.groupBy("rule").agg(F.count(F.when(F.col("vulnerable"), 1)).alias("tp"), F.count(F.when(~F.col("vulnerable"), 1)).alias("fp"))


def marker_gate(markers: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markers that a finding catches within a line, and findings near no marker (BEN-04)."""
    m, f = markers.withColumn("line", F.col("line").cast("long")), findings.withColumn("line", F.col("line").cast("long"))
    return band(m, f, ["file"], "line", 1), band(f, m, ["file"], "line", 1, "left_anti")


def pair_gate(rows: DataFrame, key: str = "pair") -> DataFrame:
    """Pairs: all vulnerable variants flagged, no fixed one (BEN-06)."""
    of = lambda v: F.when(F.col("variant") == v, F.col("flagged"))
    g = rows.groupBy(key).agg(F.bool_and(of("vulnerable")).alias("caught"), F.bool_or(of("fixed")).alias("noisy"))
    return g.withColumn("passed", F.coalesce("caught", F.lit(False)) & ~F.coalesce("noisy", F.lit(False)))


def first_flip(steps: DataFrame, key: str = "case") -> DataFrame:
    """Of each case's rewriting steps (step, name, flagged) the first whose verdict differs from step 0's (BEN-05)."""
    start = steps.where("step = 0").select(key, F.col("flagged").alias("_start"))
    flips = steps.join(start, key).where(F.col("flagged") != F.col("_start"))
    return flips.groupBy(key).agg(F.min("step").alias("step"), F.min_by("name", "step").alias("cause"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("rule", "file", "line")) -> DataFrame:
    """Identities of two runs with the side they are of: both, only_a, only_b (JOIN-21, BEN-08)."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side: Column = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return x.join(y, list(keys), "full").select(*keys, side.alias("side"))
