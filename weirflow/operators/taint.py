"""From untrusted sources to sensitive sinks, asked backward (GR-10..22, FLT-01..14, JOIN-13, WIN-01, WIN-02).

All sink arguments of a program are roots of one walk (``reach_in_context``).
A walk stops at a source, a guard or a sanitizer that makes the value safe for
the root's label. Verdicts: any source reached is vulnerable, else anything
that cannot be resolved is unknown, else anything sanitized, else clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as V
from ..functions.names import callee_keys, last_segment
from ..functions.text import fingerprint
from ..storage import small_or_plain, write_table
from . import facts as K
from . import reach as R
from .program import Program
from .windows import first_per


#: Labels of sinks in one scan.
MAX_LABELS = 1_000
#: Facts given by the caller up to which they are broadcast.
MAX_BROADCAST_FACTS = 100_000


def sink_roots(p: Program, sinks: DataFrame | None = None) -> DataFrame:
    """root, call, slot, node, sink, label, role: the arguments of armed sink calls.

    A sink that needs a receiver is armed by its last segment on a call through
    one; any other by its full name. Functions of the program are no sinks. The
    receiver is slot -1, of sinks armed on every slot or on -1.
    """
    sinks = small_or_plain(sinks, MAX_BROADCAST_FACTS) if sinks is not None else F.broadcast(K.sinks(p.lowered.sparkSession))
    calls = p.part("calls").where("not again").join(p.bindings.select("call"), "call", "left_anti")
    tail = last_segment(F.col("resolved"))
    c = calls.select("family", "call", "callee", "resolved", tail.alias("tail"))
    # two equal joins instead of one with an OR
    named = c.withColumn("sink", F.col("resolved")).join(sinks.where("not receiver"), ["family", "sink"])
    method = c.where(F.contains("resolved", F.lit("."))).withColumn("sink", F.col("tail")).join(sinks.where("receiver"), ["family", "sink"])
    armed_calls = first_per(named.unionByName(method), ["call"], F.length("sink").desc(), F.col("label"))
    args = p.part("args").where("slot >= -1").select("call", "slot", "node", "literal")
    roots = armed_calls.join(args, "call").where((F.size("slots") == 0) | F.array_contains("slots", F.col("slot")))
    return roots.select(F.concat_ws("|", "call", "slot").alias("root"), "call", "slot", "node", "sink", "label", V.role_of(F.col("label")).alias("role"))


def source_nodes(p: Program, sources: DataFrame | None = None) -> DataFrame:
    """node, source: nodes whose path a registered source covers."""
    sources = sources if sources is not None else K.sources(p.lowered.sparkSession)
    from ..functions.names import dotted_prefixes

    n = p.part("nodes").where("path <> '' and kind in ('load', 'call', 'global', 'param')").select("family", "node", "path")
    asked = n.select("family", "node", "path", F.explode(dotted_prefixes(F.col("path"))).alias("pattern"))
    hit = asked.join(small_or_plain(sources, MAX_BROADCAST_FACTS), ["family", "pattern"])
    # a bare name that is only a parameter is no builtin
    params = p.part("nodes").where("kind = 'param'").select("node")
    return hit.join(params, "node", "left_anti").groupBy("node").agg(F.min("path").alias("source"))


def stops(p: Program, roots: DataFrame, source: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """node, label, reason: where a walk of a label ends."""
    held = roots.select("label", "role").distinct().limit(MAX_LABELS + 1).collect()
    if len(held) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels of sinks")
    none = F.array().cast("array<struct<label:string,role:string>>")
    labels = F.explode(F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.role).alias("role")) for r in held]) if held else none).alias("l")
    san = sanitizers if sanitizers is not None else K.sanitizers(p.lowered.sparkSession)
    calls = p.part("calls").where("result is not null").select("family", F.col("result").alias("node"), "resolved")
    named = calls.select("node", "family", F.explode(callee_keys(F.col("resolved"))).alias("sanitizer")).join(small_or_plain(san, MAX_BROADCAST_FACTS), ["family", "sanitizer"])
    named = named.select("node", "effect", labels).select("node", "effect", "l.label", "l.role")
    works = named.where(V.defeats(V.sanitizer_kind(F.col("effect")), F.col("role"), F.col("label"))).select("node", "label", F.lit("sanitizer").alias("reason"))
    guard = p.part("nodes").where("kind = 'guard'").select("node", labels).select("node", "l.label", F.lit("guard").alias("reason"))
    src = source.select("node", labels).select("node", "l.label", F.lit("source").alias("reason"))
    return src.unionByName(works).unionByName(guard).groupBy("node", "label").agg(F.max("reason").alias("reason"))


def propagated(p: Program, propagators: DataFrame | None = None) -> DataFrame:
    """call, node (its result), slots of the calls of which it is known which arguments pass into the result (FCT-07)."""
    facts = propagators if propagators is not None else K.propagators(p.lowered.sparkSession)
    calls = p.part("calls").where("result is not null").select("family", "call", F.col("result").alias("node"), F.explode(callee_keys(F.col("resolved"))).alias("key"))
    return calls.join(small_or_plain(facts.withColumnRenamed("call", "key"), MAX_BROADCAST_FACTS), ["family", "key"]).select("call", "node", "slots")


def passing_edges(p: Program, known: DataFrame) -> DataFrame:
    """The program's edges without those from a result to arguments that its call does not pass on."""
    args = p.part("args").where("node is not null and slot >= -1").select("call", "slot", "node").join(known.select("call", "slots"), "call")
    passes = F.max(F.array_contains("slots", F.col("slot"))).alias("passes")
    held = args.groupBy(F.col("call").alias("site"), F.col("node").alias("next")).agg(passes).where("not passes").select("site", "next", F.lit("through").alias("kind"))
    return p.edges.join(held, ["site", "next", "kind"], "left_anti")


def findings(p: Program, sinks: DataFrame | None = None, sources: DataFrame | None = None, sanitizers: DataFrame | None = None, propagators: DataFrame | None = None) -> DataFrame:
    """One row per sink argument, whatever its verdict, and per receiver that is vulnerable (GR-20).

    file, fn, line, sink, callee, slot, label, role, verdict, source, steps
    (path of nodes from source to sink for vulnerable ones), cut_reasons.
    """
    roots = write_table(sink_roots(p, sinks), "roots")
    source = write_table(source_nodes(p, sources), "sources")
    ends = write_table(stops(p, roots, source, sanitizers), "ends")
    known = write_table(propagated(p, propagators), "propagators")
    edges = write_table(passing_edges(p, known).select("node", "next", "kind", "site"), "program")
    states = R.reach_in_context(roots.where("node is not null").select("root", "label", "node"), edges, ends.select("node", "label"), ["label"])
    states = write_table(states, "states")
    kinds = p.part("nodes").select("node", F.col("kind").alias("what"))
    leaves = states.select("root", "label", "node").distinct().join(ends, ["node", "label"], "left")
    leaves = leaves.join(edges.select("node").distinct().withColumn("_more", F.lit(True)), "node", "left").join(kinds, "node", "left")
    # a result to which nothing passes is known, not open
    leaves = leaves.join(known.select("node").distinct().withColumn("_known", F.lit(True)), "node", "left")
    dead = F.col("reason").isNull() & F.col("_more").isNull()
    reason = F.coalesce("reason", F.when(dead & F.col("_known"), "value-const").when(dead & F.col("what").isin("param", "call", "global"), "unresolvable").when(dead, "no-source"))
    seen = leaves.withColumn("reason", reason)
    r = F.col("reason")
    per = seen.groupBy("root").agg(
        R.verdict(r == "source", r == "unresolvable", r == "sanitizer").alias("verdict"),
        F.array_sort(F.collect_set(F.when(r != "source", r))).alias("cut_reasons"), F.count(F.lit(1)).alias("n_states"),
    )
    first = first_per(states.join(ends.where("reason = 'source'").select("node", "label"), ["node", "label"], "left_semi"), ["root"], F.col("depth"), F.col("node"))
    origin = first.select("root", "node").join(source, "node").select("root", F.col("node").alias("source_node"), "source")
    trail = R.paths(first_per(states, ["root", "node"], F.col("depth"), F.col("parent").asc_nulls_first()), first.select("root", "node"))
    lines = p.part("nodes").select("node", F.col("line").alias("at"), F.col("kind").alias("what"), F.col("path").alias("name"), "fn")
    steps = trail.select("root", F.posexplode("path").alias("i", "node")).join(lines, "node")
    steps = steps.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("i", F.col("what").alias("kind"), F.col("fn").alias("func"), F.col("name").alias("detail"), F.col("at").alias("line")))).alias("steps"))
    calls = p.part("calls").select("call", "file", "family", "fn", "callee", "line")
    out = roots.select("root", "call", "slot", "sink", "label", "role").distinct().join(per, "root", "left").join(origin, "root", "left").join(steps, "root", "left").join(calls, "call")
    # an undecided receiver says nothing about what its call consumes
    out = out.where("slot >= 0 or verdict = 'vulnerable'")
    # an argument that is a literal has no node: clean, as its value is fixed
    return out.select(
        "file", "family", "fn", "line", "sink", "callee", "slot", "label", "role", F.coalesce("verdict", F.lit("clean")).alias("verdict"), "source",
        F.when(F.col("verdict") == "vulnerable", F.col("steps")).alias("steps"), F.coalesce("cut_reasons", F.array(F.lit("value-const"))).alias("cut_reasons"),
    )


#: Object keys that name one record's owner (fixed values).
IDENTITY_KEYS = ("id", "_id", "user_id", "userId", "owner_id", "ownerId", "account_id", "accountId", "uuid")
#: Calls that look one record up by its keys, by last segment.
LOOKUPS = ("find_one", "findOne", "get_or_404", "filter_by", "update_one", "updateOne", "delete_one", "deleteOne", "find_one_and_update")
AUTH_GUARDS = ("login_required", "require_auth", "check_owner", "authorize", "has_permission", "permission_required", "requires_auth")


def direct_references(p: Program, sources: DataFrame | None = None) -> DataFrame:
    """Records looked up by an untrusted identity without a check of who asks (FLT-07, FLT-08).

    A lookup whose object, or named argument, has an identity key and whose value
    comes from a source; one behind an authorisation call or decorator is exempt.
    """
    args = p.part("args").where("slot >= 0")
    keyed_ = F.arrays_overlap("keys", F.array(*map(F.lit, IDENTITY_KEYS)))
    ident = args.where(F.coalesce(keyed_, F.lit(False)) | F.coalesce(F.col("name").isin(*IDENTITY_KEYS), F.lit(False)))
    calls = p.part("calls").where(~F.col("again") & last_segment(F.col("resolved")).isin(*LOOKUPS))
    hit = calls.select("call").join(ident, "call").select("call", "slot").distinct()
    lookups = F.array(*map(F.lit, LOOKUPS))
    families = p.part("calls").select("family").distinct()
    sinks = families.select("family", F.explode(lookups).alias("sink"), F.lit("idor").alias("label"), F.array().cast("array<int>").alias("slots"), F.lit(True).alias("receiver"))
    found = findings(p, sinks, sources).where("verdict = 'vulnerable'")
    places = p.part("calls").select("call", "fn", "line", "callee", "block", "doms", "idx")
    found = found.join(places, ["fn", "line", "callee"]).join(hit, ["call", "slot"], "left_semi")
    guards = p.part("calls").where(last_segment(F.col("resolved")).isin(*AUTH_GUARDS)).select("fn", F.col("block").alias("gb"), F.col("idx").alias("gi"))
    before = ((F.col("gb") == F.col("block")) & (F.col("gi") < F.col("idx"))) | ((F.col("gb") != F.col("block")) & F.array_contains("doms", F.col("gb")))
    safe = found.join(guards, "fn").where(before).select("call").distinct()
    decorated = p.part("functions").where(F.arrays_overlap("guards", F.array(*map(F.lit, AUTH_GUARDS)))).select("fn")
    return found.join(safe, "call", "left_anti").join(decorated, "fn", "left_anti").select("file", "fn", "line", "callee", "slot", "source").distinct()


def explain(found: DataFrame) -> DataFrame:
    """Why sinks are silent: verdict and cut reasons of all that are not vulnerable (UDF-07)."""
    return found.where("verdict <> 'vulnerable'").select("file", "fn", "line", "sink", "slot", "verdict", F.array_join("cut_reasons", ",").alias("cut_reasons"))


def advisories(found: DataFrame) -> DataFrame:
    """Reportable findings: vulnerable, of a rule that is not generic, once per place and shape."""
    rule = V.rule_of(F.col("label"), F.col("role"))
    a = found.where("verdict = 'vulnerable'").withColumn("rule_id", rule).where(~F.col("rule_id").isin(*V.GENERIC_RULES))
    a = a.withColumns({
        "severity": V.default_level(F.col("role")), "confidence": F.lit(0.9), "tier": F.lit("stable"), "n_steps": F.coalesce(F.size("steps"), F.lit(0)),
        "fingerprint": fingerprint(F.col("file"), F.col("sink"), F.col("fn"), F.col("source")),
    })
    exact = first_per(a, ["file", "line", "sink", "source"], F.col("slot"), F.col("callee"))
    return first_per(exact, ["fingerprint", "line"], F.col("n_steps").desc(), F.col("slot"))
