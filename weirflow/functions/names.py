"""Names of calls, paths and packages (FN-01..10, 33..37). All plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decorations that name a sibling of a call (fixed values).
MIRROR_SUFFIXES = ("Async", "Sync", "Callback", "Promise")
#: Separator of joined keys: the unit separator.
UNIT = "\x1f"
#: Literal tokens that stand for nothing (fixed values).
NULL_TOKENS = ("null", "nil", "None", "NULL", "undefined", "nullptr")


def last_segment(c: Column) -> Column:
    """What follows the last '.', then the last '::'."""
    return F.element_at(F.split(F.element_at(F.split(c, r"\."), -1), "::"), -1)


def strip_quotes(c: Column) -> Column:
    """Without one matching pair of single, double or back quotes."""
    return F.regexp_replace(c, r"(?s)^(['\"`])(.*)\1$", "$2")


def mirror_base(c: Column) -> Column:
    """The base operation of a decorated call name, else null."""
    base = F.regexp_extract(c, r"^(.+?)(?:" + "|".join(MIRROR_SUFFIXES) + ")$", 1)
    return F.when(base != "", base)


def callee_matches(taught: Column, written: Column) -> Column:
    """A bare name matches a last segment or its mirror base, a qualified one a dotted tail."""
    qualified = F.contains(taught, F.lit(".")) | F.contains(taught, F.lit("::"))
    seg = last_segment(written)
    t, w = F.replace(taught, F.lit("::"), F.lit(".")), F.replace(written, F.lit("::"), F.lit("."))
    return F.when(qualified, (w == t) | F.endswith(w, F.concat(F.lit("."), t))).otherwise((seg == taught) | F.coalesce(mirror_base(seg) == taught, F.lit(False)))


def callee_keys(written: Column) -> Column:
    """All names that ``callee_matches`` would take for a written call, for equal joins: its dotted tails and the base of its last segment."""
    parts = F.split(F.replace(written, F.lit("::"), F.lit(".")), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.array_compact(F.concat(tails, F.array(mirror_base(F.element_at(parts, -1))))))


def path_root(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), 1)


def dotted_prefixes(c: Column) -> Column:
    """All dotted prefixes of a path, the path itself last."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def source_path_matches(paths: DataFrame, path: str, sources: DataFrame, pattern: str) -> DataFrame:
    """The rows of ``paths`` that a registered source covers (FN-08).

    A source covers itself and what lies below it; a bare root covers what lies
    below only if no rule for a part of that root is registered.
    """
    rules = sources.select(F.col(pattern).alias("_s")).distinct()
    granular = rules.where(F.contains("_s", F.lit("."))).select(path_root(F.col("_s")).alias("_root")).distinct()
    live = rules.join(granular, F.col("_s") == F.col("_root"), "left").select("_s", F.col("_root").isNotNull().alias("_exact_only"))
    asked = paths.select(F.col(path).alias("_p")).distinct().select("_p", F.explode(dotted_prefixes(F.col("_p"))).alias("_s"))
    hit = asked.join(live, "_s").where((F.col("_s") == F.col("_p")) | ~F.col("_exact_only")).select(F.col("_p").alias(path)).distinct()
    return paths.join(hit, path, "left_semi")


def keyed(*parts: Column) -> Column:
    """Joined key of several parts; null parts are empty."""
    return F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def fields_match(a: Column, b: Column) -> Column:
    return (a == b) | (a == "*") | (b == "*")


def has_hint(c: Column, hints: Sequence[str]) -> Column:
    """Whether the text contains one of the hints, in any letter case."""
    return F.coalesce(F.lower(c).rlike("|".join(hints)), F.lit(False))


def path_matches(a: Column, b: Column) -> Column:
    """Equal paths, or one ends with '/' and the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def normalize_package(c: Column) -> Column:
    """Without the scheme of built-in modules."""
    return F.regexp_replace(F.trim(c), "^node:", "")


def package_prefixes(c: Column) -> Column:
    """A package and what encloses it, longest first, by '/' and '.'; a bare '@scope' is none."""
    parts = F.split(F.regexp_replace(c, r"([/.])", "\x1e$1"), "\x1e")
    all_ = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
    return F.filter(all_, lambda x: ~x.rlike(r"^@[^/]*$") & (x != ""))


def is_null_token(c: Column) -> Column:
    return c.isin(*NULL_TOKENS)
