"""Policies and checks on the events stand-in: a user's day is a function, the table the module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import Requirement, Sequenced, named_literal, violations
from ..operators.windows import first_per
from ..session import table
from .base import Book

book = Book()
DAY = Sequenced(("user_id", "day"), ("ts", "event_id"), "event_type")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """The events as calls: their day, and literals and keys of their arguments."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.withColumns({"slot": (F.col("user_id") % 10).cast("string"), "k": F.get_json_object("props", "$.k"), "keys": F.json_object_keys("props")})


_CALLS = "with e as (select *, cast(ts as date) as day from events) "
_BEFORE = "over (partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding)"


def _policy(name: str, sql: str, trigger: str, *requirements: Requirement, extra=None) -> None:  # noqa: ANN001
    @book.query(name, _CALLS + sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        more = [extra()] if extra else []
        return violations(calls(spark, d), DAY, F.expr(trigger), requirements, more).select("event_id", "user_id")


_policy(
    "pol01_guard_before",
    f"select event_id, user_id from (select *, max(event_type = 'signup') {_BEFORE} as g from e) where event_type = 'purchase' and not coalesce(g, false)",
    "event_type = 'purchase'", Requirement("guard_call", ("signup",)),
)
_policy(
    "pol02_not_call",
    "select event_id, user_id from (select *, max(event_type = 'error') over (partition by user_id, day) as g from e) where event_type = 'purchase' and g",
    "event_type = 'purchase'", Requirement("not_call", ("error",)),
)
_policy(
    "pol03_range_check",
    "select event_id, user_id from e where event_type = 'purchase' and not coalesce(value >= 10 and value <= 50, false)",
    "event_type = 'purchase'", Requirement("range_check", column="value", low=10, high=50),
)
_policy(
    "pol04_require_any",
    f"select event_id, user_id from (select *, max(event_type in ('signup', 'click')) {_BEFORE} as g from e) where event_type = 'purchase' and not coalesce(g, false)",
    "event_type = 'purchase'", Requirement("require_call", ("signup", "click")),
)
_policy(
    "pol05_banned_literal",
    "select event_id, user_id from e where event_type = 'view' and coalesce(cast(user_id % 10 as varchar) in ('3', '7'), false)",
    "event_type = 'view'", Requirement("banned_literal", literals=("3", "7"), column="slot"),
)
_policy(
    "pol06_required_literal",
    "select event_id, user_id from e where event_type = 'view' and not coalesce(json_extract_string(props, '$.k') in ('1', '2', '3'), false)",
    "event_type = 'view'", Requirement("required_literal", literals=("1", "2", "3"), column="k"),
)
_policy(
    "pol07_required_key",
    "select event_id, user_id from e where event_type = 'click' and not list_has_any(json_keys(props), ['scope', 'token'])",
    "event_type = 'click'", Requirement("required_key", literals=("scope", "token"), column="keys"),
)
_NAMED = "props is not null and regexp_matches(props, '\"k\"\\s*:') and regexp_matches(props, '\"k\"\\s*:\\s*[\"0-9]')"
_policy(
    "pol08_required_named",
    f"select event_id, user_id from e where event_type = 'error' and not (case when {_NAMED} then json_extract_string(props, '$.k') in ('13', '39', '58', '75', '96') else coalesce(regexp_matches(props, '\"k\"\\s*:'), false) end)",
    "event_type = 'error'", extra=lambda: named_literal("props", "k", ("13", "39", "58", "75", "96"), banned=False),
)
_policy(
    "pol09_banned_named",
    f"select event_id, user_id from e where event_type = 'error' and not (case when {_NAMED} then json_extract_string(props, '$.k') not in ('13', '39', '58', '75', '96') else true end)",
    "event_type = 'error'", extra=lambda: named_literal("props", "k", ("13", "39", "58", "75", "96"), banned=True),
)
_policy(
    "pol10_module_scope",
    "select event_id, user_id from e where event_type = 'purchase' and not (select bool_or(event_type = 'refund') from e)",
    "event_type = 'purchase'", Requirement("guard_call", ("refund",), module=True),
)


@book.query("chk03_ranked_rule", """
with rules(ord, kind, low, rule) as (values (1, 'error', 60.0, 'severe_error'), (2, 'error', 0.0, 'any_error'), (3, 'purchase', 80.0, 'large_purchase'), (4, '*', 90.0, 'extreme_value'))
select event_id, rule from (select event_id, rule, row_number() over (partition by event_id order by ord) as r
  from events join rules on (kind = event_type or kind = '*') and value >= low) where r = 1
""")  # fmt: skip
def chk03(spark: SparkSession, d: str) -> DataFrame:
    """The first matching rule of each call: exact and wildcard rules joined apart."""
    rules = F.broadcast(spark.createDataFrame([(1, "error", 60.0, "severe_error"), (2, "error", 0.0, "any_error"), (3, "purchase", 80.0, "large_purchase"), (4, "*", 90.0, "extreme_value")], "ord int, kind string, low double, rule string"))
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    named = e.join(rules.where("kind <> '*'"), (F.col("event_type") == F.col("kind")) & (F.col("value") >= F.col("low")))
    # wildcard rules are few: as one array per row instead of a product
    wild = [r for r in rules.where("kind = '*'").orderBy("ord").collect()]
    any_ = e.select("event_id", F.explode(F.filter(F.array(*[F.when(F.col("value") >= r.low, F.struct(F.lit(r.ord).alias("ord"), F.lit(r.rule).alias("rule"))) for r in wild]), lambda x: x.isNotNull())).alias("w")).select("event_id", "w.ord", "w.rule")
    return first_per(named.select("event_id", "ord", "rule").unionByName(any_), ["event_id"], F.col("ord").asc()).select("event_id", "rule")


@book.query("chk04_one_per_scope", """
select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as r from events where event_type = 'error') where r = 1
""")  # fmt: skip
def chk04(spark: SparkSession, d: str) -> DataFrame:
    return first_per(table(spark, d, "events").where("event_type = 'error'"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@book.query("chk11_guard_anywhere", """
select event_id from events e where event_type = 'purchase' and not exists (select 1 from events g where g.user_id = e.user_id and g.event_type = 'signup' and cast(g.ts as date) = cast(e.ts as date))
""")  # fmt: skip
def chk11(spark: SparkSession, d: str) -> DataFrame:
    """Triggers without a guard anywhere in their scope, whatever the order."""
    return violations(calls(spark, d), DAY, F.col("event_type") == "purchase", (Requirement("any_call", ("signup",)),)).select("event_id")


@book.query("agg20_divergence", f"""
{_CALLS}, anywhere as (select event_id from e where event_type = 'purchase' and not exists (select 1 from e g where g.user_id = e.user_id and g.event_type = 'signup' and g.day = e.day)),
before as (select event_id from (select *, max(event_type = 'signup') {_BEFORE} as g from e) where event_type = 'purchase' and not coalesce(g, false))
select event_id, 'left' as side from (select * from anywhere except select * from before)
union all select event_id, 'right' from (select * from before except select * from anywhere)
""")  # fmt: skip
def agg20(spark: SparkSession, d: str) -> DataFrame:
    """Where the presence rule and the order rule differ."""
    from ..operators.joins import divergence

    return divergence(chk11(spark, d), book.queries["pol01_guard_before"](spark, d).select("event_id"))
