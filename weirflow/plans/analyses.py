"""Analyses within functions, scores and reports on the driver's tables.

An order is a function and its lines, in a fixed order, its blocks or
instructions: a line with flag R can be skipped, one with flag A allocates, R
releases, N uses. Orders have a bounded number of lines, so a function stays small.
Samples of families are cases: a positive is vulnerable, and a sample is flagged
by the sinks that two families or more teach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import has_hint
from ..functions.severity import parse_label
from ..functions.text import canonical_cwe
from ..operators import checks, intra, report
from ..operators import facts as K
from ..operators import mining as M
from ..operators import score as S
from ..session import table
from .base import Book
from .texts import _CALLS, _SAMPLES, call_names, samples

book = Book()

# ---------------------------------------------------------------- orders as functions

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus"
_LINES = f"""lines as (select l_orderkey as o, l_returnflag as flag, l_linestatus as status, cast(l_quantity as bigint) as q,
  row_number() over (partition by l_orderkey order by {_ORDER}) as pos, count(*) over (partition by l_orderkey) as n from lineitem)"""
_STATE = "last_value(case when flag in ('A', 'R') then flag end ignore nulls) over (partition by o order by pos rows between unbounded preceding and 1 preceding)"


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """fn (order), pos (1..n), n, flag, status, q of every line."""
    w = Window.partitionBy("l_orderkey")
    order = [c.strip() for c in _ORDER.split(",")]
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("fn"), F.row_number().over(w.orderBy(*order)).alias("pos"), F.count(F.lit(1)).over(w).alias("n"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("bigint").alias("q"),
    )


def _chain(lines: DataFrame) -> DataFrame:
    """Control flow from block to block, past a line that can be skipped."""
    step = lines.select("fn", (F.col("pos") - 1).alias("src"), F.col("pos").alias("dst"))
    skip = lines.where("flag = 'R' and pos < n").select("fn", (F.col("pos") - 1).alias("src"), (F.col("pos") + 1).alias("dst"))
    return step.unionByName(skip)


def _key() -> Column:
    return F.col("fn").cast("bigint").alias("orderkey")


@book.query("gr02_dominators", f"with {_LINES} select o as orderkey, pos as block, cast(2 + count(case when flag <> 'R' then 1 end) over (partition by o order by pos rows between unbounded preceding and 1 preceding) as bigint) as n_doms from lines")
def gr02(spark: SparkSession, d: str) -> DataFrame:
    """How many blocks dominate each block; one that can be skipped dominates only itself."""
    lines = order_lines(spark, d)
    doms = intra.dominators(lines.select("fn", F.col("pos").alias("block")), _chain(lines))
    return doms.where("block > 0").groupBy(_key(), "block").agg(F.count(F.lit(1)).alias("n_doms"))


@book.query("gr01_phi_places", f"""
with recursive {_LINES}, walk(o, var, b) as (
  select o, status, pos from lines
  union
  select w.o, w.var, l.pos + 1 from walk w join lines l on l.o = w.o and (l.pos = w.b or l.pos = w.b + 1 and exists (select 1 from lines k where k.o = w.o and k.pos = w.b and k.flag = 'R')) where l.flag = 'R' and l.pos < l.n)
, defs as (select distinct o, status as var, pos as b from lines),
phis as (select distinct w.o, w.var, l.pos + 1 as b from walk w join lines l on l.o = w.o and (l.pos = w.b or l.pos = w.b + 1 and exists (select 1 from lines k where k.o = w.o and k.pos = w.b and k.flag = 'R')) where l.flag = 'R' and l.pos < l.n)
select o as orderkey, var, b as block from phis
""")  # fmt: skip
def gr01(spark: SparkSession, d: str) -> DataFrame:
    """Where a variable that lines set needs a phi: at merges that one of its settings reaches past another way."""
    lines = order_lines(spark, d)
    places = intra.phi_places(lines.select("fn", F.col("pos").alias("block"), F.col("status").alias("var")), _chain(lines))
    return places.select(_key(), "var", "block")


_ARMS = f"""{_LINES}, arms as (select o, cast(coalesce(sum(q) filter (where flag = 'R'), 0) as bigint) as a, cast(coalesce(sum(q) filter (where flag <> 'R'), 0) as bigint) as b from lines group by 1),
hull as (select o, least(a, b) as lo, greatest(a, b) as hi from arms),
iv as (select o, 3 as block, lo, hi from hull union all select o, 4, lo, case when lo <= 59 then least(hi, 59) else hi end from hull union all select o, 5, case when hi >= 60 then greatest(lo, 60) else lo end, hi from hull)"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of returned and of other lines on two arms, joined, then split at 60."""
    lines = order_lines(spark, d)
    text = lambda v: F.lit(v).cast("string")
    fns = lines.select("fn").distinct()
    zero = fns.select("fn", F.lit(0).alias("block"), F.lit(0).alias("idx"), text("acc").alias("dest"), text("const").alias("op"), text("0").alias("a"), text(None).alias("b"))
    add = lines.select("fn", F.when(F.col("flag") == "R", 1).otherwise(2).alias("block"), F.col("pos").alias("idx"), text("acc").alias("dest"), text("+").alias("op"), text("acc").alias("a"), F.col("q").cast("string").alias("b"))
    branch = fns.select("fn", F.explode(F.expr("array(struct(0 as block, 'open' as var, '==' as op, 0L as k, 1 as on_true, 2 as on_false), struct(3 as block, 'acc' as var, '<' as op, 60L as k, 4 as on_true, 5 as on_false))")).alias("x")).select("fn", "x.*")
    cfg = fns.select("fn", F.explode(F.expr("array(struct(0 as src, 1 as dst), struct(0 as src, 2 as dst), struct(1 as src, 3 as dst), struct(2 as src, 3 as dst), struct(3 as src, 4 as dst), struct(3 as src, 5 as dst))")).alias("x")).select("fn", "x.*")
    return intra.value_intervals(zero.unionByName(add), branch, cfg)


@book.query("gr23_edge_sharpen", f"with {_ARMS} select o as orderkey, block, lo as low, hi as high from iv")
def gr23(spark: SparkSession, d: str) -> DataFrame:
    """The interval of a value where two arms join, and on both sides of a branch after it."""
    return _intervals(spark, d).where("var = 'acc' and block >= 3 and converged").select(_key(), F.col("block").cast("int").alias("block"), "low", "high")


@book.query("chk08_bounds", f"with {_ARMS} select o as orderkey, block, hi as high, 40 + o_custkey % 60 as capacity from iv join orders on o_orderkey = o where block >= 4 and hi >= 40 + o_custkey % 60")
def chk08(spark: SparkSession, d: str) -> DataFrame:
    """Accesses whose index may leave the capacity of their buffer, on either side of the branch."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("fn"), F.lit("buf").alias("buffer"), (40 + F.col("o_custkey") % 60).alias("capacity"))
    accesses = orders.select("fn", "buffer", F.lit("acc").alias("index"), F.explode(F.array(F.lit(4).cast("bigint"), F.lit(5).cast("bigint"))).alias("block"))
    out = intra.out_of_bounds(accesses, _intervals(spark, d), orders)
    return out.where("rule = 'out_of_bounds_access'").select(_key(), F.col("block").cast("int").alias("block"), "high", "capacity")


def _lifetimes(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d)
    op = F.when(F.col("flag") == "A", "alloc").when(F.col("flag") == "R", "free").otherwise("use")
    events = lines.select("fn", F.lit(0).alias("block"), F.col("pos").alias("idx"), op.alias("op"), F.lit("m").alias("loc"))
    ends = lines.select("fn", F.lit(0).alias("block"), (F.col("n") + 1).alias("idx"), F.lit("exit").alias("op"), F.lit(None).cast("string").alias("loc")).distinct()
    none = spark.createDataFrame([], "fn string, src int, dst int")
    return intra.lifetimes(events.unionByName(ends), none)


def _lifetime_query(name: str, rule: str, sql: str) -> None:
    @book.query(name, f"with {_LINES}, s as (select *, {_STATE} as state from lines) select o as orderkey, pos as idx from s where {sql}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _lifetimes(spark, d).where(F.col("rule") == rule).select(_key(), F.col("idx").cast("int").alias("idx"))


_lifetime_query("chk07_use_after_free", "use_after_free", "flag = 'N' and state = 'R'")
_lifetime_query("chk07_double_free", "double_free", "flag = 'R' and state = 'R'")
_lifetime_query("chk07_uninitialized_free", "uninitialized_free", "flag = 'R' and state is null")


@book.query("chk10_leak", f"with {_LINES} select o as orderkey from (select o, max_by(flag, pos) as flag from lines where flag in ('A', 'R') group by 1) where flag = 'A'")
def chk10(spark: SparkSession, d: str) -> DataFrame:
    """Orders that end while something is still allocated."""
    return _lifetimes(spark, d).where("rule = 'memory_leak'").select(_key())


@book.query("gr06_points_to", f"""
with {_LINES}, reached as (select o, flag, pos, max(case when flag = 'A' then pos end) over (partition by o order by pos) as loc from lines)
select o as orderkey, 'A' || loc as loc from (select distinct o, loc from reached where flag = 'N' and loc is not null)
""")  # fmt: skip
def gr06(spark: SparkSession, d: str) -> DataFrame:
    """What a field may point to after all stores: lines of flag A allocate, others copy, those of flag N store into it."""
    lines = order_lines(spark, d)
    var, before = F.concat(F.lit("v"), "pos"), F.concat(F.lit("v"), F.col("pos") - 1)
    t = lambda v: F.lit(v).cast("string")
    moves = lines.select("fn", F.when(F.col("flag") == "A", "alloc").otherwise("copy").alias("op"), var.alias("dest"), F.when(F.col("flag") == "A", F.concat(F.lit("A"), "pos")).otherwise(before).alias("src"), t(None).alias("field"))
    stores = lines.where("flag = 'N'").select("fn", t("store").alias("op"), t("o").alias("dest"), var.alias("src"), t("f").alias("field"))
    fns = lines.select("fn").distinct()
    ends = fns.select("fn", t("alloc").alias("op"), t("o").alias("dest"), t("O").alias("src"), t(None).alias("field")).unionByName(fns.select("fn", t("load").alias("op"), t("w").alias("dest"), t("o").alias("src"), t("f").alias("field")))
    return intra.points_to(moves.unionByName(stores).unionByName(ends)).where("var = 'w'").select(_key(), "loc")


@book.query("agg18_must_reach", f"with {_LINES} select o as orderkey from lines group by 1 having bool_and(status = 'F')")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    """Orders at whose end something holds on every path: each line is an arm of its own."""
    lines = order_lines(spark, d)
    facts = lines.select("fn", F.col("pos").alias("block"), F.lit("done").alias("fact"), (F.col("status") == "F").alias("holds"))
    last = F.col("n") + 1
    cfg = lines.select("fn", F.lit(0).cast("bigint").alias("src"), F.col("pos").cast("bigint").alias("dst")).unionByName(lines.select("fn", F.col("pos").cast("bigint").alias("src"), last.alias("dst")))
    ends = lines.select("fn", last.alias("block")).distinct()
    return intra.must_hold(facts, cfg).join(ends, ["fn", "block"], "left_semi").select(_key())


@book.query("agg08_branch_sum", f"with {_LINES} select o as orderkey, 1 + count(*) filter (where flag = 'R') + cast(coalesce(sum(q) filter (where flag = 'A'), 0) as bigint) as complexity, count(*) as n_instructions from lines group by 1 having 1 + count(*) filter (where flag = 'R') + coalesce(sum(q) filter (where flag = 'A'), 0) > 25")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    """One plus branches plus switch arms, above the limit."""
    kinds = order_lines(spark, d).select("fn", F.when(F.col("flag") == "R", "branch").when(F.col("flag") == "A", "switch").otherwise("plain").alias("kind"), F.col("q").alias("arms"))
    return checks.complexity_of(kinds).where(F.col("complexity") > checks.MAX_COMPLEXITY).select(_key(), "complexity", "n_instructions")


# ---------------------------------------------------------------- samples as cases

_FLAGS = f"""{_SAMPLES}, {_CALLS},
delta as (select fam_no, lang, name, bool_or(variant = 'positive') as pos, bool_or(variant = 'negative') as neg from names group by 1, 2, 3),
taught as (select lang, name from delta where pos and not neg and lang is not null group by 1, 2 having count(*) >= 2),
hits as (select fam_no, variant, count(*) as findings from names join taught using (lang, name) group by 1, 2),
cwe as (select fam_no, 'CWE-' || nullif(regexp_extract(trim(meta['cwe']), '^(?i)CWE-0*([0-9]+)$', 1), '') as cwe, list_last(string_split(declared_check_call, '.')) as declared from families),
cases as (select distinct fam_no, variant, variant = 'positive' as vulnerable, cwe, declared from samples join cwe using (fam_no)),
seen as (select c.*, coalesce(h.findings, 0) as findings, exists (select 1 from names n where n.fam_no = c.fam_no and n.variant = c.variant) as called,
  exists (select 1 from names n where n.fam_no = c.fam_no and n.variant = c.variant and n.name = c.declared) and cwe is not null as own from cases c left join hits h using (fam_no, variant)),
outcomes as (select cwe, vulnerable, case when not called then 'ERR' when vulnerable then case when own then 'TP' else 'FN' end else case when findings > 0 then 'FP' else 'TN' end end as conservative,
  case when not called then 'ERR' when vulnerable then case when findings > 0 then 'TP' else 'FN' end else case when findings > 0 then 'FP' else 'TN' end end as any_ from seen)"""


def _card(mode: str) -> str:
    n = lambda o: f"count(*) filter (where {mode} = '{o}')"
    rate = lambda a, b: f"coalesce(round({n(a)} / nullif({n(a)} + {n(b)}, 0), 3), 0)"
    return f"select case when grouping(cwe) = 1 then '(total)' else coalesce(cwe, '(none)') end as grp, {n('TP')} as tp, {n('FP')} as fp, {n('FN')} as fn, {n('TN')} as tn, {n('ERR')} as err, {rate('TP', 'FN')} as tpr, {rate('FP', 'TN')} as fpr from outcomes group by rollup(cwe)"


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, results and named weaknesses of the samples, as ``score.classify`` takes them."""
    ident = F.concat_ws("/", "fam_no", "variant").alias("id")
    names = call_names(spark, d)
    f = table(spark, d, "families").select("fam_no", canonical_cwe(F.col("meta")["cwe"]).alias("cwe"), F.element_at(F.split("declared_check_call", r"\."), -1).alias("name"))
    cases = samples(spark, d).select("fam_no", "variant").distinct().join(f, "fam_no").select(ident, (F.col("variant") == "positive").alias("vulnerable"), "cwe")
    taught = M.votes(M.proposals(names).where("kind = 'sink' and lang is not null"), ["lang", "name"]).where("status = 'confirmed'").select("lang", "name", F.lit(1).alias("hit"))
    per = names.join(taught, ["lang", "name"], "left").groupBy("fam_no", "variant").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("findings"))
    named = names.join(f.where("cwe is not null"), ["fam_no", "name"]).select(ident, "cwe").distinct()
    return cases, per.select(ident, "findings", F.lit(None).cast("string").alias("error")), named


@book.query("agg12_scorecard", f"with {_FLAGS} " + _card("conservative"))
def agg12(spark: SparkSession, d: str) -> DataFrame:
    """A confusion matrix per weakness and in total, with rates."""
    return S.scorecard(S.classify(*_cases(spark, d))).drop("score")


@book.query("ben03_regressions", f"with {_FLAGS}, a as ({_card('conservative')}), b as ({_card('any_')}) select grp, a.tpr, b.tpr as tpr_before, a.fpr, b.fpr as fpr_before from a join b using (grp) where a.tpr < b.tpr - 0.05 or a.fpr > b.fpr + 0.05")
def ben03(spark: SparkSession, d: str) -> DataFrame:
    """Weaknesses for which conservative matching is worse than taking any finding."""
    c = _cases(spark, d)
    return S.regressions(S.scorecard(S.classify(*c)), S.scorecard(S.classify(*c, mode="any")), 0.05)


@book.query("ben06_pair_gate", f"""with {_FLAGS}, g as (select fam_no, coalesce(bool_and(findings > 0) filter (where vulnerable), false) as caught, coalesce(bool_or(findings > 0) filter (where not vulnerable), false) as noisy from seen group by 1)
select fam_no, caught, noisy, caught and not noisy as passed from g""")  # fmt: skip
def ben06(spark: SparkSession, d: str) -> DataFrame:
    """Pairs: the vulnerable side must be flagged by a taught sink, the fixed one by none."""
    cases, results, _ = _cases(spark, d)
    rows = cases.join(results, "id", "left").select(F.substring_index("id", "/", 1).cast("bigint").alias("fam_no"), F.when(F.col("vulnerable"), "vulnerable").otherwise("fixed").alias("variant"), (F.coalesce("findings", F.lit(0)) > 0).alias("flagged"))
    return S.pair_gate(rows, "fam_no").select("fam_no", F.coalesce("caught", F.lit(False)).alias("caught"), F.coalesce("noisy", F.lit(False)).alias("noisy"), "passed")


@book.query("agg13_per_rule", f"with {_FLAGS} select name as rule, count(distinct fam_no) filter (where variant = 'positive') as tp, count(distinct fam_no) filter (where variant = 'negative') as fp from names join taught using (lang, name) group by 1")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    """Per taught sink the positive and negative samples it hits, each family once."""
    names = call_names(spark, d)
    taught = M.votes(M.proposals(names).where("kind = 'sink' and lang is not null"), ["lang", "name"]).where("status = 'confirmed'").select("lang", "name")
    return S.per_rule(names.join(taught, ["lang", "name"]).select(F.col("name").alias("rule"), F.col("fam_no").alias("id"), (F.col("variant") == "positive").alias("vulnerable")))


@book.query("snk10_corpus_coverage", "select lang, meta['class'] as class, count(*) as n_families from families group by 1, 2")
def snk10(spark: SparkSession, d: str) -> DataFrame:
    return report.corpus_coverage(table(spark, d, "families"))


@book.query("min03_noise", f"with {_SAMPLES}, {_CALLS} select name, count(*) as n from names where name not in ({', '.join(repr(x) for x in M.NOISE)}) and name <> '' group by 1")
def min03(spark: SparkSession, d: str) -> DataFrame:
    """Calls that could be taught, with the samples they occur in."""
    return M.without_noise(call_names(spark, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@book.query("set05_subset", f"""with {_SAMPLES}, {_CALLS}, k as (select distinct fam_no, name from names where variant = 'positive'), n as (select fam_no, count(*) as c from k group by 1),
j as (select a.fam_no as a, b.fam_no as b, count(*) as c from k a join k b on a.name = b.name and a.fam_no <> b.fam_no group by 1, 2)
select j.a as a, j.b as b, case when x.c = y.c then 'same' else 'subset' end as relation from j join n x on x.fam_no = j.a join n y on y.fam_no = j.b where j.c = x.c and x.c >= 3 and (x.c < y.c or (x.c = y.c and j.a = (select min(z.a) from j z join n w on w.fam_no = z.a where z.b = j.b and z.c = y.c and w.c = y.c) and j.a < j.b))
""")  # fmt: skip
def set05(spark: SparkSession, d: str) -> DataFrame:
    """Families whose positives call the same as, or no more than, another one's; of three calls at least."""
    return M.set_relations(call_names(spark, d).where("variant = 'positive'").select("fam_no", "name"), "fam_no", "name", least=3)


@book.query("min12_teachability", f"""with {_FLAGS}, per as (select fam_no, coalesce(bool_or(findings > 0) filter (where vulnerable), false) as pos, coalesce(bool_or(findings > 0) filter (where not vulnerable), false) as neg from seen group by 1),
k as (select fam_no, count(*) filter (where pos <> neg) as n_candidates from delta group by 1)
select fam_no, case when pos and not neg then 'already separates' when pos and neg then 'negative alerts too' when coalesce(n_candidates, 0) = 0 then 'no difference in calls' else 'no candidate reaches the positive' end as gap
from per left join k using (fam_no)""")  # fmt: skip
def min12(spark: SparkSession, d: str) -> DataFrame:
    """Why a family teaches nothing, or that it separates already."""
    cases, results, _ = _cases(spark, d)
    hit = cases.join(results, "id", "left").withColumns({"fam_no": F.substring_index("id", "/", 1).cast("bigint"), "hit": F.coalesce("findings", F.lit(0)) > 0})
    of = lambda v: F.coalesce(F.bool_or(F.when(F.col("vulnerable") == v, F.col("hit"))), F.lit(False))
    n = M.proposals(call_names(spark, d)).groupBy("fam_no").agg(F.count(F.lit(1)).alias("n"))
    trial = hit.groupBy("fam_no").agg(of(True).alias("pos"), of(False).alias("neg")).join(n, "fam_no", "left").withColumn("n_candidates", F.coalesce("n", F.lit(0)))
    return M.teachability(trial).select("fam_no", "gap")


@book.query("agg10_guard_union", f"""with {_FLAGS}, t as (select fam_no, name as trigger from delta where pos and not neg), g as (select fam_no, name as guard from delta where neg and not pos)
select trigger, string_agg(guard, ',' order by guard) as guards from (select distinct trigger, guard from t join g using (fam_no)) group by 1 having count(*) >= 2""")  # fmt: skip
def agg10(spark: SparkSession, d: str) -> DataFrame:
    """For each call of positives only the calls that any family's negatives add to it."""
    p = M.proposals(call_names(spark, d))
    t, g = p.where("kind = 'sink'").select("fam_no", F.col("name").alias("trigger")), p.where("kind = 'sanitizer'").select("fam_no", F.col("name").alias("guard"))
    return M.guard_union(t.join(g, "fam_no")).select("trigger", F.array_join("guards", ",").alias("guards"))


@book.query("fn16_severity", "select fam_no, case lower(trim(meta['severity'])) when 'critical' then 'critical' when 'high' then 'warning' when 'medium' then 'warning' when 'warning' then 'warning' when 'low' then 'info' when 'info' then 'info' end as level from families")
def fn16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "families").select("fam_no", parse_label(F.col("meta")["severity"]).alias("level"))


@book.query("fn33_hints", f"select distinct func, regexp_matches(lower(func), '{'|'.join(checks.CREDENTIAL_HINTS)}') as credential, regexp_matches(lower(func), '{'|'.join(checks.URL_HINTS)}') as address from function_timings where func is not null")
def fn33(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose names hint at credentials or addresses."""
    f = table(spark, d, "function_timings").where("func is not null").select("func").distinct()
    return f.select("func", has_hint(F.col("func"), checks.CREDENTIAL_HINTS).alias("credential"), has_hint(F.col("func"), checks.URL_HINTS).alias("address"))


# ---------------------------------------------------------------- findings and reports


@book.query("ben02_tag_weaknesses", """
with m(tag, cwe) as (values ('sql', 'CWE-89'), ('shell', 'CWE-78'), ('html', 'CWE-79'), ('redirect', 'CWE-601'), ('query', 'CWE-89'))
select distinct finding_id as id, cwe from (select finding_id, unnest([sink_label, sink_role]) as tag from sink_findings) join m using (tag)
""")  # fmt: skip
def ben02(spark: SparkSession, d: str) -> DataFrame:
    """The weaknesses that a finding's tags stand for."""
    mapping = spark.createDataFrame([("sql", "CWE-89"), ("shell", "CWE-78"), ("html", "CWE-79"), ("redirect", "CWE-601"), ("query", "CWE-89")], "tag string, cwe string")
    tags = table(spark, d, "sink_findings").select(F.col("finding_id").alias("id"), F.array(F.array("sink_label"), F.array("sink_role")).alias("tag_sets"))
    return S.tag_weaknesses(tags, mapping)


_NEAR = """with m as (select distinct trim(file) as file, line from explain_snapshots where lower(trim(verdict)) = 'sanitized' and file is not null and line is not null),
f as (select distinct trim(file) as file, line from explain_snapshots where lower(trim(verdict)) = 'unknown' and file is not null and line is not null)"""


@book.query("ben04_marker_gate", _NEAR + """
select 'caught' as side, file, line from m where exists (select 1 from f where f.file = m.file and abs(f.line - m.line) <= 1)
union all select 'unexpected', file, line from f where not exists (select 1 from m where f.file = m.file and abs(f.line - m.line) <= 1)
""")  # fmt: skip
def ben04(spark: SparkSession, d: str) -> DataFrame:
    """Markers that a finding catches within a line, and findings near none."""
    e = table(spark, d, "explain_snapshots").where("file is not null and line is not null").select(F.trim("file").alias("file"), F.col("line").cast("bigint").alias("line"), F.lower(F.trim("verdict")).alias("v"))
    caught, other = S.marker_gate(e.where("v = 'sanitized'").drop("v").distinct(), e.where("v = 'unknown'").drop("v").distinct())
    return caught.select(F.lit("caught").alias("side"), "file", "line").unionByName(other.select(F.lit("unexpected").alias("side"), "file", "line"))


@book.query("ben05_first_flip", """
with s as (select user_id, event_type as name, event_type = 'error' as flagged, row_number() over (partition by user_id order by ts, event_id) - 1 as step from events),
o as (select user_id, flagged as first from s where step = 0)
select user_id, min(step) as step, min_by(name, step) as cause from s join o using (user_id) where flagged <> first group by 1
""")  # fmt: skip
def ben05(spark: SparkSession, d: str) -> DataFrame:
    """The first step at which a user's verdict differs from that of their first event."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return S.first_flip(table(spark, d, "events").select("user_id", step.cast("bigint").alias("step"), F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("flagged")), "user_id")


@book.query("join21_full_outer", """
with a as (select distinct sink, file, line from explain_snapshots where snap_no % 2 = 0), b as (select distinct sink, file, line from explain_snapshots where snap_no % 2 = 1)
select coalesce(a.sink, b.sink) as sink, coalesce(a.file, b.file) as file, coalesce(a.line, b.line) as line, case when a.sink is null then 'only_b' when b.sink is null then 'only_a' else 'both' end as side
from (from a where sink is not null and file is not null and line is not null) a full join (from b where sink is not null and file is not null and line is not null) b on a.sink = b.sink and a.file = b.file and a.line = b.line
""")  # fmt: skip
def join21(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, of even and of odd snapshots, compared by identity."""
    e = table(spark, d, "explain_snapshots").where("sink is not null and file is not null and line is not null")
    return S.compare_runs(e.where("snap_no % 2 = 0"), e.where("snap_no % 2 = 1"), ("sink", "file", "line"))


_GATED = """g as (select *, case when sink_role in ('markup') then 'hygiene' when sink_role = 'redirect' then 'beta' else 'stable' end as tier, case when arg_slot = -1 then 0.5 else 0.9 end as confidence,
  case sink_label when 'shell' then 'critical' when 'sql' then 'warning' else 'info' end as severity from sink_findings)"""


@book.query("flt14_gate_ledger", f"with {_GATED} select case when tier in ('beta', 'hygiene') then 'below-tier' when confidence < 0.6 then 'below-confidence' when severity = 'info' then 'below-severity' else 'kept' end as gate, count(*) as n from g group by 1")
def flt14(spark: SparkSession, d: str) -> DataFrame:
    """Findings by the first gate that drops them."""
    role = F.col("sink_role")
    a = table(spark, d, "sink_findings").withColumns({
        "tier": F.when(role == "markup", "hygiene").when(role == "redirect", "beta").otherwise("stable"), "confidence": F.when(F.col("arg_slot") == -1, 0.5).otherwise(0.9),
        "severity": F.when(F.col("sink_label") == "shell", "critical").when(F.col("sink_label") == "sql", "warning").otherwise("info"),
    })
    return report.ledger(report.gated(a, min_confidence=0.6, min_level="warning"))


@book.query("join14_overlay", """
with p(rule_id, title, severity) as (values ('shell', 'Command built from input', 'critical'), ('sql', 'Query built from input', null))
select finding_id, coalesce(p.title, f.sink) as title, coalesce(p.severity, 'info') as severity from sink_findings f left join p on p.rule_id = f.sink_label
""")  # fmt: skip
def join14(spark: SparkSession, d: str) -> DataFrame:
    """Findings with what a bundle says about their rule; its words win where it has any."""
    patterns = spark.createDataFrame([("shell", "Command built from input", None, None, None, "critical"), ("sql", "Query built from input", None, None, None, None)], "rule_id string, title string, observation string, impact string, improvement string, severity string")
    a = table(spark, d, "sink_findings").select("finding_id", F.col("sink_label").alias("rule_id"), F.col("sink").alias("title"), F.lit("info").alias("severity"))
    return report.overlay(a, patterns).select("finding_id", "title", "severity")


@book.query("agg05_coverage", """
with e as (select trim(file) as file, line, sink, arg_slot, lower(trim(verdict)) as verdict from explain_snapshots where file is not null),
f as (select file, bool_or(line is null) as failed, bool_or(sink is null) as partial from e group by 1)
select (select count(*) from f) as n_files, (select count(*) from f where not failed) as n_analysed, (select count(*) from f where failed) as n_failed, (select count(*) from f where partial) as n_partial,
  (select count(*) from (select distinct file, line, sink, arg_slot from e)) as n_sites, (select count(*) from e where verdict = 'unknown') as n_unknown, (select count(*) from e where verdict = 'vulnerable') as n_vulnerable,
  (select string_agg(file, ',' order by file) from (select distinct file from e where verdict = 'unknown' order by file limit 25)) as unresolved_sample
""")  # fmt: skip
def agg05(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of all files, distinct sites, and a sorted sample of 25 files left open."""
    e = table(spark, d, "explain_snapshots").where("file is not null").select(F.trim("file").alias("file"), "line", "sink", F.col("arg_slot").alias("slot"), F.lower(F.trim("verdict")).alias("verdict"))
    status = e.groupBy("file").agg(F.when(F.bool_or(F.col("line").isNull()), "no line").alias("error"), F.bool_or(F.col("sink").isNull()).alias("partial"))
    return report.coverage(status, e).withColumn("unresolved_sample", F.array_join("unresolved_sample", ","))


@book.query("agg06_merge", "select project, count(*) as n, count(distinct trim(file)) as n_files, (select string_agg(f, ',' order by f) from (select distinct trim(x.file) as f from explain_snapshots x where x.project is not distinct from e.project and x.file is not null order by f limit 5)) as sample from explain_snapshots e group by 1")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of projects merged from that of their snapshots: sums add up, sets unite, samples are cut again."""
    e = table(spark, d, "explain_snapshots")
    part = e.groupBy("project", "snap_no").agg(F.count(F.lit(1)).alias("n"))
    files = e.select("project", "snap_no", F.trim("file").alias("file"))
    return report.merge_coverage(part, files, ["project"], 5).withColumn("sample", F.array_join("sample", ","))


@book.query("agg07_phase_merge", """
select lower(trim(phase)) as phase, cast(sum(ms) as varchar) as total_ms, max(ms) as slowest_ms, count(*) as n from phase_timings where ms >= 0 and ms < 9223372036854775807 group by 1
""")  # fmt: skip
def agg07(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry of all scans by phase; sums may pass 64 bits, so they come as text."""
    p = table(spark, d, "phase_timings").where("ms >= 0 and ms < 9223372036854775807").select(F.lower(F.trim("phase")).alias("phase"), "ms")
    return report.merge_phases(p).withColumn("total_ms", F.col("total_ms").cast("string"))


@book.query("agg02_stats", """
select count(*) as n_arguments, count(distinct func) as n_functions, count(distinct (sink, arg_slot)) as n_slots, count(*) filter (where lower(verdict) = 'vulnerable') as n_vulnerable, count(*) filter (where lower(verdict) = 'unknown') as n_unknown,
  count(*) filter (where lower(verdict) = 'sanitized') as n_sanitized, count(*) filter (where lower(verdict) = 'clean') as n_clean from sink_findings
""")  # fmt: skip
def agg02(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sink_findings").select(F.col("func").alias("fn"), "sink", F.col("arg_slot").alias("slot"), F.lower("verdict").alias("verdict"))
    return report.statistics(f)


@book.query("agg03_funnel", """
with c as (select sink, sink not like '%.%' as bare, split_part(sink, '.', -1) as tail, sink_role from sink_findings where sink is not null),
s as (select case when sink_role = 'query' then 'program-local' when tail in ('query_raw', 'search_raw', 'run_shell') then 'sink' when bare then 'local' else 'not-a-sink' end as stage, sink from c)
select stage, count(*) as n, case when stage = 'not-a-sink' then (select string_agg(sink, ',' order by k desc, sink) from (select sink, count(*) as k from s where stage = 'not-a-sink' group by 1 order by k desc, sink limit 3)) end as top from s group by 1
""")  # fmt: skip
def agg03(spark: SparkSession, d: str) -> DataFrame:
    """Call sites by how far they came, and the most frequent callees that no fact names."""
    calls = table(spark, d, "sink_findings").where("sink is not null").select(F.col("sink").alias("callee"), (F.col("sink_role") == "query").alias("bound"))
    sinks = spark.createDataFrame([("query_raw",), ("search_raw",), ("run_shell",)], "sink string")
    return report.funnel(calls, sinks, 3).withColumn("top", F.array_join("top", ","))


@book.query("agg19_timing_stats", "select file, round(avg(ms / 1000.0), 3) as mean_s, min(ms) as min_ms, max(ms) as max_ms, count(*) as n from file_timings where ms >= 0 and ms < 9223372036854775807 and file <> '' group by 1")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_timings").where("ms >= 0 and ms < 9223372036854775807 and file <> ''")
    return report.timing_stats(f, ["file"], "ms")


@book.query("snk04_code_frames", r"""
with a as (select doc_id, 1 + doc_id % 5 as line, string_split(text, chr(10)) as t from documents where text is not null), w as (select doc_id, line, t, unnest([line - 1, line, line + 1]) as n from a)
select cast(doc_id as varchar) as file, line, n, replace(t[n], chr(9), '    ') as text from w where n >= 1 and n <= len(t)
""")  # fmt: skip
def snk04(spark: SparkSession, d: str) -> DataFrame:
    """The lines around a place of every document, tabs expanded."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"), (1 + F.col("doc_id") % 5).alias("line"))
    return report.code_frames(docs.select(F.col("path").alias("file"), "line"), docs.select("path", "source"))


@book.query("fct05_key_floor", "select p_brand as key, max(p_size) as min_bits from part group by 1")
def fct05(spark: SparkSession, d: str) -> DataFrame:
    """Key sizes that several layers ask for: the largest holds."""
    return K.key_floors(table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("min_bits")))
