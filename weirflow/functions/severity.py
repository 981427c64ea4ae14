"""Severities, roles, sanitizer effects and rule cards (FN-16..22) as columns and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six labels and their three levels.
LEVEL_OF_LABEL = {"critical": "critical", "high": "warning", "medium": "warning", "warning": "warning", "low": "info", "info": "info"}
LEVEL_ORDER = {"info": 0, "warning": 1, "critical": 2}
TIER_ORDER = {"stable": 0, "beta": 1, "experimental": 2, "hygiene": 2}
PROFILE_TIER = {"default": 0, "recommended": 1, "strict": 2}
# The level that a sink role has of itself.
LEVEL_OF_ROLE = {"execution": "critical", "other": "critical", "resource": "warning", "storage": "warning", "crypto": "warning", "xss": "warning", "response": "info", "validation": "info"}
# Sink labels by role.
ROLE_OF_LABEL = {
    "sql": "execution", "nosql": "execution", "command": "execution", "code": "execution", "template": "execution", "deserialize": "execution",
    "ldap": "execution", "xpath": "execution", "graphql": "execution", "xxe": "execution", "prototype": "execution", "regex": "execution",
    "format_string": "execution", "ssrf": "resource", "redirect": "resource", "traversal": "resource", "toctou": "resource", "storage": "storage",
    "jwt": "crypto", "xss": "xss", "response": "response", "log_leak": "response", "credential_leak": "response", "header_injection": "response",
    "cookie_poisoning": "response", "content_type": "response", "jwt_decode": "validation",
}
# Rule slug, id and CWE numbers of the taint rules.
TAINT_RULES = (
    ("sql", "taint.sql-injection", (89,)), ("nosql", "taint.nosql-injection", (943,)), ("command", "taint.command-injection", (78,)),
    ("execution", "taint.code-injection", (94,)), ("template", "taint.template-injection", (1336, 94)), ("traversal", "taint.path-traversal", (22,)),
    ("ssrf", "taint.ssrf", (918,)), ("redirect", "taint.open-redirect", (601,)), ("xss", "taint.xss", (79,)),
    ("deserialize", "taint.unsafe-deserialization", (502,)), ("ldap", "taint.ldap-injection", (90,)), ("xpath", "taint.xpath-injection", (643,)),
    ("graphql", "taint.graphql-injection", (943,)), ("xxe", "taint.xxe", (611,)), ("prototype", "taint.prototype-pollution", (1321,)),
    ("regex", "taint.regex-dos", (1333,)), ("header_injection", "taint.header-injection", (113,)), ("cookie_poisoning", "taint.cookie-poisoning", (565,)),
    ("content_type", "taint.content-type-injection", (436,)), ("storage", "taint.untrusted-storage-write", (20,)),
    ("log_leak", "taint.sensitive-data-in-log", (532,)), ("response", "taint.sensitive-data-in-response", (200,)),
    ("credential_leak", "taint.credential-exposure", (522,)), ("toctou", "taint.toctou", (367,)), ("jwt", "taint.jwt-misuse", (347,)),
    ("buffer_overflow", "taint.buffer-overflow", (120, 787)), ("format_string", "taint.format-string", (134,)),
    ("idor", "taint.insecure-direct-object-reference", (639,)), ("injection", "taint.injection", (74,)), ("other", "taint.untrusted-data", (20,)),
)
#: Too generic to be reported.
GENERIC_RULES = ("taint.injection", "taint.untrusted-data")
#: CWE numbers too broad to name a class (fixed values).
BROAD_CWES = (20, 74, 693)
# Sanitizer slugs and their aliases.
SANITIZER_ALIASES = {"encode": "full", "allowlist": "full", "generic": "full"}
SANITIZER_KINDS = ("full", "session_trust", "html_escape", "url_encode", "sql_parameterize", "nosql_parameterize", "path_normalize")


def _case(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def parse_label(c: Column) -> Column:
    """The level of a severity label; null for an unknown one."""
    return _case(F.lower(F.trim(c)), LEVEL_OF_LABEL)


def default_level(role: Column) -> Column:
    return _case(role, LEVEL_OF_ROLE)


def role_of(label: Column) -> Column:
    return F.coalesce(_case(label, ROLE_OF_LABEL), F.lit("other"))


def level_rank(level: Column) -> Column:
    return _case(level, {k: str(v) for k, v in LEVEL_ORDER.items()}).cast("int")


def sanitizer_kind(slug: Column) -> Column:
    """The kind a slug stands for; null cuts nothing."""
    plain = F.coalesce(_case(slug, SANITIZER_ALIASES), slug)
    return F.when(plain.isin(*SANITIZER_KINDS), plain)


def defeats(kind: Column, role: Column, label: Column) -> Column:
    """Whether a sanitizer kind makes a value safe for a sink's role or label."""
    return F.coalesce(
        F.when(kind.isin("full", "session_trust"), True)
        .when(kind == "html_escape", role.isin("xss", "response"))
        .when(kind == "url_encode", role.isin("response", "resource"))
        .when(kind == "sql_parameterize", label == "sql")
        .when(kind == "nosql_parameterize", label == "nosql")
        .when(kind == "path_normalize", (role == "resource") | (label == "traversal")),
        F.lit(False),
    )


def rule_of(label: Column, role: Column, idor: Column | None = None) -> Column:
    """The rule id of a sink: identity keys first, then its label, then its role."""
    by = {slug: rule for slug, rule, _ in TAINT_RULES}
    named = F.coalesce(_case(label, by), _case(role, by), F.lit("taint.untrusted-data"))
    return named if idor is None else F.when(idor, by["idor"]).otherwise(named)


def rule_dimension(spark: SparkSession) -> DataFrame:
    """rule_id, slug, cwe: one row per CWE of each taint rule."""
    rows = [(rule, slug, f"CWE-{c}", c in BROAD_CWES) for slug, rule, cwes in TAINT_RULES for c in cwes]
    return spark.createDataFrame(rows, "rule_id string, slug string, cwe string, broad boolean")
