"""Learning from labelled pairs (MIN-01..12): proposals, votes, gates, lint.

``calls`` holds fam_no, lang, variant ('positive' or 'negative') and name, each
once. A fact separates a family if it flags a positive and no negative.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_plain, write_table


def proposals(calls: DataFrame) -> DataFrame:
    """fam_no, lang, name, kind: calls of positives only are sinks, of negatives only sanitizers."""
    per = calls.groupBy("fam_no", "lang", "name").agg(F.bool_or(F.col("variant") == "positive").alias("pos"), F.bool_or(F.col("variant") == "negative").alias("neg"))
    return per.where("pos <> neg").select("fam_no", "lang", "name", F.when(F.col("pos"), "sink").otherwise("sanitizer").alias("kind"))


def votes(proposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, support (families), status: confirmed from two on."""
    n = proposed.groupBy(*keys).agg(F.count_distinct("fam_no").alias("support"))
    return n.withColumn("status", F.when(F.col("support") >= 2, "confirmed").otherwise("provisional"))


def guard_union(proposed: DataFrame) -> DataFrame:
    """Per trigger the guards that any family shows; two and more make an any-of policy (MIN-05)."""
    per = proposed.groupBy("trigger").agg(F.array_sort(F.collect_set("guard")).alias("guards"))
    return per.where(F.size("guards") >= 2)


def independent_gate(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates judged each by itself: separates at least one family, makes no negative noisy."""
    per = calls.groupBy("fam_no", *keys).agg(F.bool_or(F.col("variant") == "positive").alias("pos"), F.bool_or(F.col("variant") == "negative").alias("neg"))
    both = per.groupBy(*keys).agg(F.count(F.when(F.col("pos") & ~F.col("neg"), 1)).alias("separates"), F.count(F.when(F.col("neg"), 1)).alias("breaks"))
    return both.where("separates > 0 and breaks = 0")


@dataclass(frozen=True)
class Candidate:
    """A fact to try: its name and kind, and the names that make a family relevant."""

    name: str
    kind: str
    order: int = 1


def replay_gate(candidates: Sequence[Candidate], alerts: Callable[[list[Candidate]], DataFrame], relevant: DataFrame) -> tuple[list[Candidate], list[tuple[Candidate, str]]]:
    """Try candidates one after the other on top of the facts published so far (MIN-06).

    ``alerts(facts)`` gives fam_no, pos, neg (does a positive, a negative alert)
    with the given facts; ``relevant`` holds fam_no, name of the calls of each
    family. Trials follow one another, as a published fact changes the later
    ones; within a trial all relevant families are one plan. Families whose
    negative alerts from the start are exempt. Returns those published and those
    rejected with the reason.
    """
    now = write_table(alerts([]).select("fam_no", "pos", "neg", F.col("neg").alias("exempt")), "gate")
    published: list[Candidate] = []
    rejected: list[tuple[Candidate, str]] = []
    for c in sorted(candidates, key=lambda c: (c.kind != "sanitizer", c.order, c.name)):
        touched = relevant.where(F.col("name") == c.name).select("fam_no").distinct()
        trial = alerts([*published, c]).join(touched, "fam_no", "left_semi").select("fam_no", F.col("pos").alias("_p"), F.col("neg").alias("_n"))
        both = write_table(now.join(trial, "fam_no", "left"), "gate")
        good, was = F.col("_p") & ~F.col("_n"), F.col("pos") & ~F.col("neg")
        broken = ~F.col("exempt") & ((was & ~good) | (F.col("_n") & ~F.col("neg")))
        # only the two numbers leave the table
        n = both.where("_p is not null").agg(F.count(F.when(good & ~was, 1)).alias("gains"), F.count(F.when(broken, 1)).alias("breaks")).first()
        if not n.gains:
            rejected.append((c, "separates no family"))
        elif n.breaks:
            rejected.append((c, "breaks a family"))
        else:
            published.append(c)
            now = both.select("fam_no", F.coalesce("_p", "pos").alias("pos"), F.coalesce("_n", "neg").alias("neg"), "exempt")
    return published, rejected


# Accessors that occur in nearly every sample and are never proposed, calls that are everyday method
# names, and how names of test doubles begin.
NOISE = (
    "get", "set", "has", "then", "catch", "finally", "toString", "valueOf", "push", "pop", "map", "filter", "reduce", "forEach", "join", "split",
    "len", "length", "keys", "values", "entries", "stringify", "parse",
)
EVERYDAY_VERBS = (
    "get", "set", "put", "post", "delete", "send", "write", "read", "run", "call", "execute", "query", "open", "close", "add", "update", "push",
    "load", "join",
)
DOUBLE_PREFIXES = ("vuln", "unsafe_", "safe_", "insecure_", "bad_", "good_", "fixed_", "patched_", "fake_", "dummy_", "sink_", "source_")


def without_noise(calls: DataFrame, name: str = "name") -> DataFrame:
    """Calls that could be taught: named, and no accessor (MIN-03)."""
    return calls.where(~F.col(name).isin(*NOISE) & (F.col(name) != ""))


def set_relations(members: DataFrame, key: str, member: str, least: int = 1) -> DataFrame:
    """a, b, relation of keys whose member sets are equal ('same') or contained ('subset') (SET-05).

    Keys of equal sets form a class: each is paired with the first of its class
    only, as are all subsets of a class with each of its members. A set is looked
    for only where its rarest member is, which every superset must have.
    """
    m = write_table(members.select(F.col(key).alias("k"), F.col(member).alias("m")).distinct(), "members")
    per = m.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("m").cast("decimal(38,0)")).alias("h"))
    per = write_table(per.withColumn("first", F.min("k").over(Window.partitionBy("n", "h"))), "sets")
    rare = m.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    classes = m.join(per.where("k = first").select("k", "n"), "k")
    probe = classes.where(F.col("n") >= least).join(rare, "m").groupBy("k", "n").agg(F.min_by("m", F.struct("df", "m")).alias("m"))
    wide = probe.toDF("a", "na", "m").join(classes.toDF("b", "m", "nb"), "m").where("a <> b and na < nb").select("a", "na", "b")
    found = wide.join(m.toDF("a", "m"), "a").join(m.toDF("b", "m"), ["b", "m"]).groupBy("a", "b", "na").agg(F.count(F.lit(1)).alias("c")).where("c = na")
    # back from the firsts of classes to their members
    one = per.select("first", "k")
    subset = found.select(F.col("a").alias("first"), "b").join(one.withColumnRenamed("k", "a"), "first").select("a", F.col("b").alias("first")).join(one.withColumnRenamed("k", "b"), "first").select("a", "b", F.lit("subset").alias("relation"))
    same = per.where((F.col("k") != F.col("first")) & (F.col("n") >= least)).select(F.col("first").alias("a"), F.col("k").alias("b"), F.lit("same").alias("relation"))
    return subset.unionByName(same)


def literal_arguments(calls: DataFrame, args: DataFrame) -> DataFrame:
    """resolved, slot, name, literal of each call's literal arguments, with how often (MIN-04)."""
    rows = calls.select("call", "resolved").join(args.where("literal is not null").select("call", "slot", "name", "literal"), "call")
    return rows.groupBy("resolved", "slot", "name", "literal").agg(F.count(F.lit(1)).alias("n"))


def family_alerts(found: DataFrame, checks: DataFrame, samples: DataFrame) -> DataFrame:
    """fam_no, pos, neg: whether a positive, a negative sample alerts (MIN-07).

    ``samples`` holds file, fam_no, variant. A sample alerts with a vulnerable
    finding of a rule that is not generic, or with a check above the info level.
    """
    hit = found.where("verdict = 'vulnerable' and label <> 'other'").select("file").unionByName(checks.where("severity <> 'info'").select("file")).distinct()
    flags = samples.join(hit.withColumn("_hit", F.lit(True)), "file", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    of = lambda v: F.coalesce(F.bool_or(F.when(F.col("variant") == v, F.col("_hit"))), F.lit(False))
    return flags.groupBy("fam_no").agg(of("positive").alias("pos"), of("negative").alias("neg"))


def downstream_echoes(found: DataFrame) -> DataFrame:
    """sink, via: findings whose path runs through the call of another sink that is found too (MIN-08)."""
    v = found.where("verdict = 'vulnerable'")
    steps = v.select("file", "line", "sink", F.explode("steps").alias("s")).where("s.kind = 'call'").select("file", "line", "sink", F.element_at(F.split("s.detail", r"\."), -1).alias("via"))
    own = v.select(F.element_at(F.split("sink", r"\."), -1).alias("via")).distinct()
    return steps.where(F.element_at(F.split("sink", r"\."), -1) != F.col("via")).join(own, "via").select("sink", "via").distinct()


def teachability(trial: DataFrame) -> DataFrame:
    """Why a family teaches nothing, from its trial flags (MIN-12)."""
    why = (
        F.when(F.col("pos") & ~F.col("neg"), "already separates").when(F.col("pos") & F.col("neg"), "negative alerts too")
        .when(F.col("n_candidates") == 0, "no difference in calls").when(~F.col("pos"), "no candidate reaches the positive").otherwise("unknown")
    )
    return trial.withColumn("gap", why)


def lint(families: DataFrame, code: DataFrame, key: str, ident: str, lang: str) -> DataFrame:
    """key, code of structural issues: one-sided families, fixes by comment only, ids in several languages."""
    full = F.trim(F.regexp_replace("source", "^ +| +$", "")) != ""
    sides = []
    for variant, column in (("p", "positives"), ("n", "negatives")):
        sides.append(families.select(key, F.explode(column).alias("m")).where("m.source is not null").select(key, F.lit(variant).alias("v"), F.col("m.source").alias("source")))
    has = sides[0].unionByName(sides[1]).groupBy(key).agg(F.bool_or((F.col("v") == "p") & full).alias("p"), F.bool_or((F.col("v") == "n") & full).alias("n"))
    one = has.where("p <> n").select(key, F.when(F.col("p"), "S001").otherwise("S002").alias("code"))
    texts = code.select(key, "variant", F.xxhash64("text").alias("h"), F.length("text").alias("l")).distinct()
    same = texts.where("variant = 'positive'").join(texts.where("variant = 'negative'").select(key, "h", "l"), [key, "h", "l"], "left_semi").select(key).distinct()
    several = families.groupBy(ident).agg(F.count_distinct(lang).alias("_n")).where("_n > 1").select(ident)
    mixed = families.join(several, ident, "left_semi").select(key)
    return one.unionByName(same.withColumn("code", F.lit("D003"))).unionByName(mixed.withColumn("code", F.lit("S006")))


# Keys of a header block, purposes, severities.
REQUIRED_KEYS = ("observation", "impact", "improvement", "cwe", "severity")
KNOWN_KEYS = (
    "observation", "impact", "improvement", "cwe", "cvss", "owasp", "severity", "check-rule", "wrap-max", "unbounded-product",
    "package", "guard", "require-arg-key", "check-call", "class", "purpose", "shape", "source", "expect",
)
PURPOSES = ("knowledge", "precision", "anchor")
SEVERITIES = ("critical", "high", "medium", "warning", "low", "info")
MIN_PROSE = 20


def lint_metadata(families: DataFrame, classes: DataFrame, key: str, meta: str = "meta", trigger: str = "declared_check_call") -> DataFrame:
    """key, code, detail of what is wrong with header blocks (MIN-10: M, C, D005 and E040 rules).

    ``classes`` holds id and cwes (an array of numbers as 'CWE-n'). A null block
    is an empty one: all its required keys are missing.
    """
    m = F.coalesce(F.col(meta), F.create_map().cast("map<string,string>"))
    rows = families.select(F.col(key), m.alias("m"), F.col(trigger).alias("t"))
    rows = rows.join(small_or_plain(classes.select(F.col("id").alias("_c"), "cwes"), 100_000), F.col("m")["class"] == F.col("_c"), "left")
    v = lambda k: F.trim(F.col("m")[k])
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    some = lambda cond, code, detail: F.array(F.when(cond, issue(code, detail)))
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED_KEYS)), F.map_keys("m")), lambda k: issue("M001", k))
    unknown = F.transform(F.array_except(F.map_keys("m"), F.array(*map(F.lit, KNOWN_KEYS))), lambda k: issue("M004", k))
    prose = F.transform(
        F.filter(F.map_entries("m"), lambda e: e["key"].isin(*REQUIRED_KEYS[:3]) & ((F.length(e["value"]) < MIN_PROSE) | F.contains(e["value"], F.lit("TODO")) | F.contains(e["value"], F.lit("<")))),
        lambda e: issue("M005", e["key"]),
    )
    cwe = F.regexp_extract(v("cwe"), r"^(?i)CWE-0*([0-9]+)$", 1)
    score = F.expr("try_cast(m['cvss'] as double)")
    name = F.lower(F.element_at(F.split("t", r"\."), -1))
    found = F.concat(
        missing, unknown, prose,
        some(v("cwe").isNotNull() & (cwe == ""), "M002", v("cwe")),
        some(v("severity").isNotNull() & ~F.lower(v("severity")).isin(*SEVERITIES), "M003", v("severity")),
        some(v("cvss").isNotNull() & ~F.coalesce(score.between(0, 10), F.lit(False)), "M006", v("cvss")),
        some(v("class").isNull(), "C001", F.lit("")),
        some(v("class").isNotNull() & F.col("_c").isNull(), "C002", v("class")),
        some(F.col("_c").isNotNull() & (cwe != "") & ~F.array_contains("cwes", F.concat(F.lit("CWE-"), cwe)), "C003", v("cwe")),
        some(~F.coalesce(v("purpose").isin(*PURPOSES), F.lit(False)), "C005", F.coalesce(v("purpose"), F.lit(""))),
        some(v("shape").isNull(), "C006", F.lit("")),
        some(F.coalesce(name.rlike(f"^({'|'.join(DOUBLE_PREFIXES)})"), F.lit(False)), "D005", F.col("t")),
        some(F.coalesce(name.isin(*EVERYDAY_VERBS), F.lit(False)) & v("package").isNull(), "E040", F.col("t")),
    )
    out = rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return out.select(key, F.col("i.code").alias("code"), F.col("i.detail").alias("detail"))
