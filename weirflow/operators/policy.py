"""Co-occurrence policies over ordered sequences (POL-01..10, WIN-06, CHK-02, CHK-11).

A sequence is any table with a scope (function, user-day, ...), an order within
it, and the name that is called. A policy says: each trigger must have all its
requirements; a violation is a trigger row for which not all hold. All
requirements of the order kind are one window over the scope, so a policy with
several shares one shuffle; requirements of the module are one aggregate.

Defined cases: no requirements, always a violation; a null name is no call; an
unresolved literal (null) holds for banned ones and fails for required ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sequenced:
    """Where the scope, the order and the called name are."""

    scope: Sequence[str]
    order: Sequence[str]
    name: str = "name"

    def before(self) -> Window:
        return Window.partitionBy(*self.scope).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)

    def whole(self) -> Window:
        return Window.partitionBy(*self.scope)


@dataclass(frozen=True)
class Requirement:
    """One requirement; ``holds`` gives its truth for each row."""

    kind: str
    names: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    column: str = ""
    low: float | None = None
    high: float | None = None
    module: bool = False
    guard: Column | None = field(default=None, compare=False)

    def holds(self, at: Sequenced) -> Column:
        called = F.coalesce(F.col(at.name).isin(*self.names), F.lit(False)) if self.names else self.guard
        never = F.lit(False)
        if self.kind in ("guard_call", "require_call"):
            return F.coalesce(F.max(called).over(at.before()), never)
        if self.kind in ("any_call", "not_call"):
            there = F.coalesce(F.max(called).over(at.whole()), never)
            return there if self.kind == "any_call" else ~there
        c = F.col(self.column)
        if self.kind == "range_check":
            known = F.lit(True)
            if self.low is not None:
                known = known & (c >= self.low)
            if self.high is not None:
                known = known & (c <= self.high)
            return F.coalesce(known, never)
        if self.kind == "banned_literal":
            return F.coalesce(~c.isin(*self.literals), F.lit(True))
        if self.kind == "required_literal":
            return F.coalesce(c.isin(*self.literals), never)
        if self.kind == "required_key":
            return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, self.literals))), never)
        raise ValueError(f"unknown requirement {self.kind}")


def named_literal(props: str, key: str, literals: Sequence[str], banned: bool) -> Column:
    """Requirement on a keyword argument held in JSON: an absent one fails where required and holds
    where banned; one that is there but is no plain text or number holds for both."""
    there = F.col(props).rlike(rf'"{key}"\s*:')
    plain = F.col(props).rlike(rf'"{key}"\s*:\s*["0-9]')
    value = F.get_json_object(props, f"$.{key}")
    if banned:
        return F.when(there & plain, ~value.isin(*literals)).otherwise(True)
    return F.when(there & plain, value.isin(*literals)).otherwise(F.coalesce(there, F.lit(False)))


def violations(rows: DataFrame, at: Sequenced, trigger: Column, requirements: Sequence[Requirement], extra: Sequence[Column] = ()) -> DataFrame:
    """The trigger rows for which not all requirements hold."""
    if any(r.module for r in requirements):
        # presence anywhere is one row of flags, not a window over the whole table
        seen = [F.coalesce(F.max(F.coalesce(F.col(at.name).isin(*r.names), F.lit(False))), F.lit(False)).alias(f"m{i}") for i, r in enumerate(requirements) if r.module]
        flags = rows.agg(*seen).first()
    truth = [F.lit(flags[f"m{i}"]) if r.module else r.holds(at) for i, r in enumerate(requirements)] + list(extra)
    out = rows.withColumns({f"_r{i}": t for i, t in enumerate(truth)}).withColumn("_t", trigger)
    ok = F.lit(bool(truth))
    for i in range(len(truth)):
        ok = ok & F.col(f"_r{i}")
    return out.where(F.col("_t") & ~ok).drop("_t", *[f"_r{i}" for i in range(len(truth))])
