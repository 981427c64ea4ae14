"""Checks on programs that are no data flow (CHK-01..06, CHK-11, CHK-12, POL on code, WIN-03).

Each check takes a Program and gives findings (check, rule, family, file, fn,
line, message, severity); ``run`` unites them in registry order and keeps the
first of equal identity. A check that fails gives a row saying so instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import callee_matches, last_segment
from . import facts as K
from .program import Program
from .windows import first_per

Check = Callable[[Program], DataFrame]
COLUMNS = ("rule", "family", "file", "fn", "line", "message", "severity")
MAX_COMPLEXITY = 25
#: Texts that name secrets (fixed values).
CREDENTIAL_HINTS = ("password", "passwd", "secret", "token", "credential", "pin")
URL_HINTS = ("url", "uri", "host", "origin", "domain", "redirect", "next", "callback")
FAST_HASHES = ("hashlib.md5", "hashlib.sha1", "hashlib.sha256", "hashlib.sha512")


def _found(df: DataFrame, rule: Column | str, message: Column | str, severity: str = "warning") -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(text(rule).alias("rule"), "family", "file", "fn", "line", text(message).alias("message"), F.lit(severity).alias("severity"))


def calls(p: Program) -> DataFrame:
    return p.part("calls").where("not again")


def weak_calls(p: Program) -> DataFrame:
    """Broken hashes and ciphers; a name that says it is not for security is exempt."""
    weak = F.broadcast(K.weak_calls(p.lowered.sparkSession))
    exempt = p.part("args").where("name = 'usedforsecurity' and literal = 'False'").select("call").distinct()
    hit = calls(p).join(weak, "resolved").join(exempt, "call", "left_anti")
    return _found(hit, F.col("rule"), F.concat(F.col("callee"), F.lit(" is broken")))


def substring_guards(p: Program) -> DataFrame:
    """Prefix and substring tests of URL-like values that feed a condition; one per function."""
    tail = last_segment(F.col("resolved"))
    tests = calls(p).where(F.col("used_in_test") & tail.isin("startswith", "endswith", "startsWith", "endsWith", "includes", "find", "indexOf"))
    about = tests.where(F.lower("callee").rlike("|".join(URL_HINTS)))
    return _found(first_per(about, ["fn"], F.col("line"), F.col("call")), "substring_allowlist_guard", "a part of a text is no proof of its origin")


def credential_hashes(p: Program) -> DataFrame:
    """Credential-named values put into fast hashes."""
    named = p.part("nodes").select("node", "path").where(F.lower("path").rlike("|".join(CREDENTIAL_HINTS)))
    args = p.part("args").where("slot = 0 and node is not null").select("call", "node")
    origin = p.part("edges").where("kind = 'flow'").select(F.col("node"), F.col("next"))
    near = args.join(origin, "node").select("call", F.col("next").alias("node")).unionByName(args)
    hit = calls(p).where(F.col("resolved").isin(*FAST_HASHES)).join(near.join(named, "node").select("call").distinct(), "call", "left_semi")
    return _found(hit, "credential_kdf_policy", "a credential needs a slow derivation")


def complexity(p: Program, limit: int = MAX_COMPLEXITY) -> DataFrame:
    f = p.part("functions").withColumn("n", F.col("branches") + 1).where(F.col("n") > limit)
    return _found(f, "function_complexity", F.concat(F.lit("complexity "), F.col("n")), "info")


def complexity_of(instructions: DataFrame) -> DataFrame:
    """fn, complexity, n_instructions of instructions (fn, kind, arms): one, each branch, each switch's arms (AGG-08)."""
    return instructions.groupBy("fn").agg(
        (F.count(F.when(F.col("kind") == "branch", 1)) + F.coalesce(F.sum(F.when(F.col("kind") == "switch", F.col("arms"))), F.lit(0)) + 1).alias("complexity"), F.count(F.lit(1)).alias("n_instructions"),
    )


def importing(p: Program, package: str) -> DataFrame:
    """file: the files that import a package or a part of it (FLT-15).

    A program of one file with imports is taken to import for all its functions (FLT-16).
    """
    i = p.part("imports").select("file", "package").distinct()
    return i.where((F.col("package") == package) | F.startswith("package", F.lit(package + ".")) | F.startswith("package", F.lit(package + "/"))).select("file").distinct()


def named_argument(p: Program, call: str, name: str, rule: str, required: Sequence[str] = (), banned: Sequence[str] = (), package: str | None = None) -> DataFrame:
    """Calls whose named argument must be, or must not be, one of the literals (POL-08, POL-09)."""
    hit = calls(p).where(callee_matches(F.lit(call), F.col("resolved")))
    if package:
        hit = hit.join(importing(p, package), "file", "left_semi")
    arg = p.part("args").where(F.col("name") == name).groupBy("call").agg(F.max("literal").alias("literal"), F.lit(True).alias("there"))
    rows = hit.join(arg, "call", "left")
    if required:
        bad = F.col("there").isNull() | (F.col("literal").isNotNull() & ~F.col("literal").isin(*required))
    else:
        bad = F.coalesce(F.col("literal").isin(*banned), F.lit(False))
    return _found(rows.where(bad), rule, F.concat(F.lit(f"{name} of "), F.col("callee")))


def guard_before(p: Program, trigger: str, guards: Sequence[str], rule: str) -> DataFrame:
    """Triggers without a guard before them: a decorator, an earlier call of the block, or one in a dominating block."""
    c = calls(p)
    t = c.where(callee_matches(F.lit(trigger), F.col("resolved")))
    g = c.where(last_segment(F.col("resolved")).isin(*guards)).select("fn", F.col("block").alias("gb"), F.col("idx").alias("gi"))
    before = ((F.col("gb") == F.col("block")) & (F.col("gi") < F.col("idx"))) | ((F.col("gb") != F.col("block")) & F.array_contains("doms", F.col("gb")))
    decorated = p.part("functions").where(F.arrays_overlap("guards", F.array(*map(F.lit, guards)))).select("fn")
    ok = t.join(g, "fn").where(before).select("call").distinct()
    return _found(t.join(ok, "call", "left_anti").join(decorated, "fn", "left_anti"), rule, F.concat(F.lit("no guard before "), F.col("callee")))


#: Words of a described bound, and arguments that enforce one (fixed values).
BOUND_WORDS = r"\b(max|min|maximum|minimum|at most|at least|between|up to|limit|less than|greater than)\b"
ENFORCERS = ("ge", "gt", "le", "lt", "max_length", "min_length", "maximum", "minimum", "max", "min", "multiple_of")


def schema_bounds(p: Program) -> DataFrame:
    """Schema fields whose description names a numeric bound that nothing enforces (CHK-06)."""
    fields = calls(p).where(last_segment(F.col("resolved")).isin("Field", "Param", "Query", "Body", "describe", "number"))
    args = p.part("args").groupBy("call").agg(
        F.bool_or(F.coalesce(F.lower("literal").rlike(BOUND_WORDS) & F.col("literal").rlike("[0-9]"), F.lit(False))).alias("described"),
        F.bool_or(F.coalesce(F.col("name").isin(*ENFORCERS), F.lit(False))).alias("enforced"),
    )
    return _found(fields.join(args, "call").where("described and not enforced"), "unbounded_number_schema", "a described bound is not enforced")


def allowlists(p: Program) -> DataFrame:
    """Sets of URL-like literals, where a containment guard is used at all (CHK-01)."""
    c = calls(p)
    used = c.where(F.col("used_in_test") & last_segment(F.col("resolved")).isin("has", "includes", "startswith")).select(F.lit(True).alias("_used")).distinct()
    lists = c.where(last_segment(F.col("resolved")).isin("Set", "Map", "set", "frozenset"))
    urls = p.part("args").where(F.col("literal").rlike("https?://")).select("call").distinct()
    return _found(lists.join(urls, "call", "left_semi").withColumn("_used", F.lit(True)).join(used, "_used", "left_semi"), "allowlist_definition_bypassable", "an allowlist of address texts")


REGISTRY: tuple[tuple[str, Check], ...] = (
    ("allowlists", allowlists),
    ("cookie_secure", lambda p: named_argument(p, "set_cookie", "secure", "cookie_secure_missing", required=("True",))),
    ("cookie_httponly", lambda p: named_argument(p, "set_cookie", "httponly", "cookie_httponly_missing", required=("True",))),
    ("transport", lambda p: named_argument(p, "requests.get", "verify", "policy_banned_insecure_transport", banned=("False",))),
    ("jwt", lambda p: named_argument(p, "jwt.decode", "verify", "insecure_jwt_algorithm", banned=("False",))),
    ("weak_calls", weak_calls),
    ("substring_guards", substring_guards),
    ("credential_hashes", credential_hashes),
    ("schema_bounds", schema_bounds),
    ("complexity", complexity),
)


def run(p: Program, registry: Sequence[tuple[str, Check]] = REGISTRY) -> DataFrame:
    """All findings, once per function, rule and line; the check that comes first keeps them."""
    parts = [check(p).select(F.lit(i).alias("ord"), F.lit(name).alias("check"), *COLUMNS) for i, (name, check) in enumerate(registry)]
    return first_per(reduce(DataFrame.unionByName, parts), ["fn", "rule", "line"], F.col("ord"), F.col("message")).drop("ord")
