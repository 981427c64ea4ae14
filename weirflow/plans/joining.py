"""Joins, lattice values, windows, aggregates and sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.names import dotted_prefixes, source_path_matches
from ..operators import joins as J
from ..operators import windows as W
from ..session import table
from .base import Book

book = Book()
_DAY_S = 86_400


def _sec(c: str = "ts"):  # noqa: ANN202
    return F.unix_seconds(F.col(c).cast("timestamp"))


# ---------------------------------------------------------------- lattice


@book.query("val_interval_join", """
select l_partkey as partkey, cast(min(l_quantity) as bigint) as low, cast(max(l_quantity) as bigint) as high, min(l_quantity) = max(l_quantity) as is_const from lineitem group by 1
""")  # fmt: skip
def val_join(spark: SparkSession, d: str) -> DataFrame:
    low, high = V.hull(F.col("l_quantity").cast("bigint"), F.col("l_quantity").cast("bigint"))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(low.alias("low"), high.alias("high")).withColumn("is_const", F.col("low") == F.col("high"))


@book.query("val_interval_transfer", """
with h as (select l_partkey, cast(min(l_quantity) as bigint) as ql, cast(max(l_quantity) as bigint) as qh, cast(min(round(l_tax * 100)) as bigint) as tl, cast(max(round(l_tax * 100)) as bigint) as th from lineitem group by 1)
select l_partkey as partkey, ql + tl as add_low, qh + th as add_high, ql - th as sub_low, qh - tl as sub_high, least(ql * tl, ql * th, qh * tl, qh * th) as mul_low, greatest(ql * tl, ql * th, qh * tl, qh * th) as mul_high,
  case when qh < p_size then 'true' when ql >= p_size then 'false' else 'unknown' end as below from h join part on p_partkey = l_partkey
""")  # fmt: skip
def val_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Interval arithmetic on hulls, and a comparison that may stay unknown."""
    q, t = F.col("l_quantity").cast("bigint"), F.round(F.col("l_tax") * 100).cast("bigint")
    h = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(q).alias("ql"), F.max(q).alias("qh"), F.min(t).alias("tl"), F.max(t).alias("th"))
    h = h.join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    a, b, size = (F.col("ql"), F.col("qh")), (F.col("tl"), F.col("th")), (F.col("p_size").cast("bigint"),) * 2
    out = [F.col("l_partkey").alias("partkey")]
    for name, f in (("add", V.add), ("sub", V.sub), ("mul", V.mul)):
        low, high = f(a, b)
        out += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return h.select(*out, F.coalesce(V.compare("<", a, size).cast("string"), F.lit("unknown")).alias("below"))


@book.query("val_branch_sharpen", """
select l_suppkey as suppkey, case when min(l_quantity) <= 30 and max(l_quantity) >= 10 then cast(greatest(min(l_quantity), 10) as bigint) else cast(min(l_quantity) as bigint) end as low,
  case when min(l_quantity) <= 30 and max(l_quantity) >= 10 then cast(least(max(l_quantity), 30) as bigint) else cast(max(l_quantity) as bigint) end as high from lineitem group by 1
""")  # fmt: skip
def val_sharpen(spark: SparkSession, d: str) -> DataFrame:
    """A hull cut to the interval of a branch; kept as it is where they do not meet."""
    h = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.min("l_quantity").cast("bigint").alias("l"), F.max("l_quantity").cast("bigint").alias("h"))
    low, high = V.intersect((F.col("l"), F.col("h")), (F.lit(10).cast("bigint"), F.lit(30).cast("bigint")))
    return h.select("suppkey", low.alias("low"), high.alias("high"))


@book.query("chk09_corner_product", """
with h as (select l_partkey, max(l_quantity) as q, max(l_extendedprice) as p from lineitem group by 1)
select l_partkey as partkey from h where cast(cast(ceil(q) as bigint) as hugeint) * cast(cast(ceil(p) as bigint) as hugeint) * 1000 > 2147483647
""")  # fmt: skip
def chk09(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose largest size and price multiply beyond 32 bits, in decimals."""
    h = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    product = F.ceil("q").cast("decimal(12,0)") * F.ceil("p").cast("decimal(18,0)") * F.lit(1000).cast("decimal(5,0)")
    return h.where(product > 2147483647).select(F.col("l_partkey").alias("partkey"))


# ---------------------------------------------------------------- joins


@book.query("join01_def_use", "select o_orderkey as orderkey, count(l_orderkey) as n_uses from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def join01(spark: SparkSession, d: str) -> DataFrame:
    """Orders define, lines use: how often each definition is used, unused ones included."""
    defs = table(spark, d, "orders").select(F.col("o_orderkey").alias("var"))
    uses = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("var"), F.monotonically_increasing_id().alias("use"))
    return J.def_use(defs, uses, ["var"], "use").select(F.col("var").alias("orderkey"), "n_uses")


@book.query("join02_call_binding_fallback", """
with exact as (select p_brand, p_type, min(p_partkey) as target from part where p_size > 25 group by 1, 2), bare as (select p_brand, min(p_partkey) as target from part group by 1)
select p.p_partkey as partkey, coalesce(e.target, b.target) as target from part p left join exact e on e.p_brand = p.p_brand and e.p_type = p.p_type left join bare b on b.p_brand = p.p_brand
""")  # fmt: skip
def join02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat_ws("\x1f", "p_brand", "p_type").alias("full"), "p_size")
    exact = p.where("p_size > 25").groupBy("full").agg(F.min("p_partkey").alias("target"))
    bare = p.groupBy("p_brand").agg(F.min("p_partkey").alias("target"))
    return J.with_fallback(p, exact, bare, "full", "p_brand", "target").select(F.col("p_partkey").alias("partkey"), "target")


_FIELD = "case when l_linenumber = 1 then '*' else cast(l_suppkey as varchar) end"


@book.query("join04_wildcard_field", f"""
with l as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as id, l_orderkey, {_FIELD} as field, l_returnflag = 'R' as st from lineitem)
select a.l_orderkey as orderkey, count(distinct (a.id, b.id)) as n_pairs from l a join l b on a.l_orderkey = b.l_orderkey and (a.field = b.field or a.field = '*' or b.field = '*') where a.st and not b.st group by 1
""")  # fmt: skip
def join04(spark: SparkSession, d: str) -> DataFrame:
    field = F.when(F.col("l_linenumber") == 1, "*").otherwise(F.col("l_suppkey").cast("string"))
    ident = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", field.alias("field"), ident.alias("id"), (F.col("l_returnflag") == "R").alias("st"))
    pairs = J.wildcard_pairs(rows.where("st").withColumnRenamed("id", "s"), rows.where("not st").withColumnRenamed("id", "l"), ["l_orderkey"], "field", "s", "l")
    return pairs.groupBy(F.col("s.l_orderkey").alias("orderkey")).agg(F.count(F.lit(1)).alias("n_pairs"))


@book.query("join05_sibling_pairs", """
select a.l_orderkey as orderkey, a.l_suppkey as supp_a, b.l_suppkey as supp_b from (select distinct l_orderkey, l_suppkey from lineitem) a join (select distinct l_orderkey, l_suppkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey
""")  # fmt: skip
def join05(spark: SparkSession, d: str) -> DataFrame:
    """Siblings of one call site; an order's lines are few, so pairs stay few."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return J.sibling_pairs(lines, ["l_orderkey"], "l_suppkey").select(F.col("l_orderkey").alias("orderkey"), F.col("a").alias("supp_a"), F.col("b").alias("supp_b"))


@book.query("join06_nearest_enclosing", """
select event_id, coalesce(last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), -1) as signup_id from events
""")  # fmt: skip
def join06(spark: SparkSession, d: str) -> DataFrame:
    return J.nearest_before(table(spark, d, "events"), F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"], "event_id", "signup_id").select("event_id", F.coalesce("signup_id", F.lit(-1)).alias("signup_id"))


@book.query("join09_reexport_chain", """
select s_suppkey as suppkey, coalesce('R' || r_regionkey, 'N' || s_nationkey) as resolved, case when r_regionkey is null then 1 else 2 end as hops from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey
""")  # fmt: skip
def join09(spark: SparkSession, d: str) -> DataFrame:
    """Imports followed through re-exports: supplier, nation, region."""
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    start = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("name"))
    links = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.concat(F.lit("N"), "s_nationkey").alias("next"))
    links = links.unionByName(n.select(F.concat(F.lit("N"), "n_nationkey").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("next")))
    return J.follow_links(start, links, "name").select(F.col("s_suppkey").alias("suppkey"), F.col("name").alias("resolved"), "hops")


@book.query("join10_alias_resolution", """
select event_type as symbol, coalesce(case event_type when 'view' then 'open' when 'click' then 'press' end, event_type) as target, count(*) as n from events group by 1, 2
""")  # fmt: skip
def join10(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("view", "open"), ("click", "press")], "symbol string, target string")
    calls = table(spark, d, "events").select(F.col("event_type").alias("symbol"))
    return J.resolve_aliases(calls, aliases, "symbol", "target").groupBy("symbol", "target").agg(F.count(F.lit(1)).alias("n"))


@book.query("join15_baseline_anti", """
with f as (select md5(concat_ws(chr(31), l_partkey, l_suppkey)) as fingerprint, l_shipdate from lineitem)
select distinct fingerprint from f where l_shipdate >= timestamp '2000-01-01' and not exists (select 1 from f b where b.fingerprint = f.fingerprint and b.l_shipdate < timestamp '1996-01-01')
""")  # fmt: skip
def join15(spark: SparkSession, d: str) -> DataFrame:
    """Findings that a baseline lacks, each once."""
    f = table(spark, d, "lineitem").select(X.fingerprint(F.col("l_partkey"), F.col("l_suppkey")).alias("fingerprint"), "l_shipdate")
    return J.new_since(f.where("l_shipdate >= '2000-01-01'").select("fingerprint"), f.where("l_shipdate < '1996-01-01'"))


_RANGES = """
with r as (select user_id, epoch_us(ts) // 1000000 - 1800 as low, epoch_us(ts) // 1000000 + 1800 as high from events where event_type = 'error'),
m as (select *, case when low > max(high) over (partition by user_id order by low, high rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as n from r),
i as (select *, sum(n) over (partition by user_id order by low, high rows between unbounded preceding and current row) as k from m),
g as (select user_id, min(low) as low, max(high) as high from i group by user_id, k)
"""


def _busy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return W.islands(e.select("user_id", (_sec() - 1800).alias("low"), (_sec() + 1800).alias("high")), ["user_id"], "low", "high")


@book.query("win07_islands", _RANGES + "select user_id, low, high from g")
def win07(spark: SparkSession, d: str) -> DataFrame:
    return _busy(spark, d)


@book.query("join17_range", _RANGES + "select event_id from events e where event_type <> 'error' and exists (select 1 from g where g.user_id = e.user_id and epoch_us(e.ts) // 1000000 between low and high)")
def join17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("event_type <> 'error'").select("event_id", "user_id", _sec().alias("at"))
    return J.in_ranges(rows, _busy(spark, d), ["user_id"], "at", "low", "high", 3600).select("event_id")


@book.query("join18_band", """
select event_id from events e where event_type = 'purchase' and exists (select 1 from events k where k.event_type = 'error' and k.user_id = e.user_id and abs(epoch_us(e.ts) // 1000000 - epoch_us(k.ts) // 1000000) <= 7200)
""")  # fmt: skip
def join18(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", _sec().alias("at"))
    return J.band(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), ["user_id"], "at", 7200).select("event_id")


# ---------------------------------------------------------------- filters and facts


@book.query("flt04_scoped_prefix", """
with f(prefix, label) as (values ('src', 'any'), ('src/web', 'web'), ('lib', 'library'), ('app/web', 'front'), ('app', 'application')),
p as (select distinct trim(file) as path from explain_snapshots where file is not null),
c as (select path, label, row_number() over (partition by path order by length(prefix) desc) as r from p join f on path = prefix or starts_with(path, prefix || '/'))
select p.path, c.label from p left join c on c.path = p.path and r = 1
""")  # fmt: skip
def flt04(spark: SparkSession, d: str) -> DataFrame:
    """The fact of the longest enclosing scope."""
    facts = F.broadcast(spark.createDataFrame([("src", "any"), ("src/web", "web"), ("lib", "library"), ("app/web", "front"), ("app", "application")], "prefix string, label string"))
    p = table(spark, d, "explain_snapshots").where("file is not null").select(F.trim("file").alias("path")).distinct()
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return W.longest_prefix(p, prefixes, facts, "prefix", ["path"]).select("path", "label")


@book.query("flt05_precedence", """
select key, payload from (select p_type as key, p_partkey as payload, row_number() over (partition by p_type order by case when p_size > 40 then 1 else 0 end desc, p_size % 3 desc, p_partkey desc) as r from part) where r = 1
""")  # fmt: skip
def flt05(spark: SparkSession, d: str) -> DataFrame:
    """Layered facts per key: a restricted one before a blanket one, then the last layer."""
    p = table(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_partkey").alias("payload"), (F.col("p_size") % 3).alias("layer"), F.col("p_partkey").alias("seq"), "p_size")
    return W.merge_layers(p, ["key"], "layer", F.when(F.col("p_size") > 40, 1).otherwise(0), "seq").select("key", "payload")


@book.query("fct03_provenance", """
select key, payload from (select p_brand as key, p_partkey as payload, row_number() over (partition by p_brand order by p_size % 3 desc, p_partkey) as r from part) where r = 1
""")  # fmt: skip
def fct03(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("payload"), (F.col("p_size") % 3).alias("provenance"), F.col("p_partkey").alias("seq"))
    return W.upsert_by_provenance(p, ["key"], "provenance", "seq").select("key", "payload")


@book.query("flt08_source_path", """
with s(p) as (values ('req'), ('ctx'), ('ctx.state'), ('input')), paths as (select distinct trim(source_desc) as path from explain_snapshots where trim(source_desc) <> '')
select path from paths where exists (select 1 from s where path = p or (starts_with(path, p || '.') and not (p = split_part(path, '.', 1) and exists (select 1 from s g where starts_with(g.p, split_part(path, '.', 1) || '.')))))
""")  # fmt: skip
def flt08(spark: SparkSession, d: str) -> DataFrame:
    """Paths that registered sources cover."""
    sources = spark.createDataFrame([("req",), ("ctx",), ("ctx.state",), ("input",)], "p string")
    paths = table(spark, d, "explain_snapshots").select(F.trim("source_desc").alias("path")).where("path <> ''").distinct()
    return source_path_matches(paths, "path", sources, "p")


@book.query("fn08_dotted_prefixes", "select distinct trim(source_desc) as path, cast(len(string_split(trim(source_desc), '.')) as integer) as depth from explain_snapshots where trim(source_desc) <> ''")
def fn08(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "explain_snapshots").select(F.trim("source_desc").alias("path")).where("path <> ''").distinct()
    return p.select("path", F.size(dotted_prefixes(F.col("path"))).alias("depth"))


# ---------------------------------------------------------------- windows, top, sets

_RICH = "row_number() over (partition by func, sink order by coalesce(len(list_filter(steps, lambda s: s is not null and s.span_start is not null)), 0) desc, finding_id)"


@book.query("win01_keep_richest", f"select finding_id, func, sink from (select *, {_RICH} as r from sink_findings) where r = 1")
def win01(spark: SparkSession, d: str) -> DataFrame:
    steps = F.coalesce(F.size(F.filter("steps", lambda s: s.isNotNull() & s["span_start"].isNotNull())), F.lit(0))
    f = table(spark, d, "sink_findings").withColumn("_n", F.when(F.col("steps").isNull(), 0).otherwise(steps))
    return W.keep_richest(f, ["func", "sink"], F.col("_n"), F.col("finding_id")).select("finding_id", "func", "sink")


@book.query("win02_exact_dedup", "select min(finding_id) as finding_id from sink_findings group by func, sink, source_desc, sink_start")
def win02(spark: SparkSession, d: str) -> DataFrame:
    return W.first_per(table(spark, d, "sink_findings"), ["func", "sink", "source_desc", "sink_start"], F.col("finding_id")).select("finding_id")


@book.query("win05_compact", "select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p <> event_type")
def win05(spark: SparkSession, d: str) -> DataFrame:
    return W.compact(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id")


@book.query("top01_slowest", """
select timing_id, file, ms from (select timing_id, file, ms, row_number() over (order by ms desc, timing_id, received_at, file) as r from file_timings where ms >= 0 and ms < 9223372036854775807) where r <= 10
""")  # fmt: skip
def top01(spark: SparkSession, d: str) -> DataFrame:
    """The ten slowest deliveries (a top-k report)."""
    f = table(spark, d, "file_timings").where("ms >= 0 and ms < 9223372036854775807")
    return f.orderBy(F.col("ms").desc(), "timing_id", "received_at", "file").limit(10).select("timing_id", "file", "ms")


@book.query("top02_capped_samples", """
select sink, string_agg(file, ',' order by file) as files from (select sink, file, row_number() over (partition by sink order by file) as r from (select distinct sink, unnest(cut_sites).file as file from sink_findings) where file is not null) where r <= 4 group by 1
""")  # fmt: skip
def top02(spark: SparkSession, d: str) -> DataFrame:
    """The four first files of the cut sites of each sink."""
    sites = table(spark, d, "sink_findings").select("sink", F.explode("cut_sites").alias("s")).select("sink", F.col("s.file").alias("file")).where("file is not null").distinct()
    ranked = sites.withColumn("r", F.row_number().over(Window.partitionBy("sink").orderBy("file"))).where("r <= 4")
    return ranked.groupBy("sink").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


@book.query("set02_distinct_edges", "select distinct o_custkey as custkey, l_suppkey as suppkey from orders join lineitem on l_orderkey = o_orderkey")
def set02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("custkey"), F.col("l_suppkey").alias("suppkey")).distinct()


@book.query("str03_round_diff", """
select fingerprint, cast(min(day) as varchar) as first_day from (select md5(concat_ws(chr(31), user_id, event_type)) as fingerprint, cast(ts as date) as day from events) group by 1
""")  # fmt: skip
def str03(spark: SparkSession, d: str) -> DataFrame:
    """The round in which each finding is new: the batch form of the watch stream."""
    e = table(spark, d, "events").select(X.fingerprint(F.col("user_id"), F.col("event_type")).alias("fingerprint"), F.to_date("ts").alias("day"))
    return e.groupBy("fingerprint").agg(F.min("day").cast("string").alias("first_day"))
