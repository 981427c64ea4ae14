"""Graph and fixpoint queries on a relational stand-in.

Vertices are suppliers, lines, orders and customers; values flow from a supplier
through a line and its order to the customer. The suppliers most in debt are
sources, returned lines sanitizers, finished orders guards, the richest suppliers
cannot be resolved; customers are the sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reach as R
from ..session import table
from .base import Book

book = Book()


def _line() -> Column:
    return F.concat(F.lit("L"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """Backward edges (node, next): customer, order, line, supplier."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    parts = [
        orders.select(F.concat(F.lit("C"), "o_custkey").alias("node"), F.concat(F.lit("O"), "o_orderkey").alias("next")),
        lines.select(F.concat(F.lit("O"), "l_orderkey").alias("node"), _line().alias("next")),
        lines.select(_line().alias("node"), F.concat(F.lit("S"), "l_suppkey").alias("next")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def flow_stops(spark: SparkSession, d: str) -> DataFrame:
    """node, reason of the vertices at which a walk ends."""
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.when(F.col("s_acctbal") < -800, "source").when(F.col("s_acctbal") > 9600, "unknown").alias("reason")).where("reason is not null")
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(_line().alias("node"), F.lit("sanitizer").alias("reason"))
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("O"), "o_orderkey").alias("node"), F.lit("guard").alias("reason"))
    return supplier.unionByName(lines).unionByName(orders)


_WALK = """
with o as (select o_custkey, o_orderkey, o_orderstatus = 'F' as guard from orders),
l as (select o_custkey, o.o_orderkey, guard, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' as sani from o join lineitem on l_orderkey = o_orderkey where not guard),
s as (select distinct o_custkey, s_suppkey, s_acctbal from l join supplier on s_suppkey = l_suppkey where not sani)
"""


@book.query("gr10_backward_reach", _WALK + """
select c_custkey as custkey,
  case when coalesce(src, false) then 'vulnerable' when coalesce(unk, false) then 'unknown' when coalesce(san, false) then 'sanitized' else 'clean' end as verdict,
  cast(1 + coalesce(no, 0) + coalesce(nl, 0) + coalesce(ns, 0) as bigint) as n_states
from customer
left join (select o_custkey, count(*) as no from o group by 1) a on a.o_custkey = c_custkey
left join (select o_custkey, count(distinct (o_orderkey, l_linenumber, l_partkey, l_suppkey)) as nl, bool_or(sani) as san from l group by 1) b on b.o_custkey = c_custkey
left join (select o_custkey, count(*) as ns, bool_or(s_acctbal < -800) as src, bool_or(s_acctbal > 9600) as unk from s group by 1) c on c.o_custkey = c_custkey
""")  # fmt: skip
def gr10(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "customer").select(F.col("c_custkey").alias("root"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    stops = flow_stops(spark, d)
    states = R.reach(roots, flow_edges(spark, d), stops)
    found = states.join(stops, "node", "left")
    r = F.col("reason")
    return found.groupBy(F.col("root").alias("custkey")).agg(R.verdict(r == "source", r == "unknown", r == "sanitizer").alias("verdict"), F.count(F.lit(1)).alias("n_states"))


@book.query("gr22_path_array", _WALK + """
, p as (select o_custkey, s_suppkey, min('L' || o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) as line from l join supplier on s_suppkey = l_suppkey where not sani and s_acctbal < -800 group by 1, 2)
select o_custkey as custkey, 'S' || s_suppkey || '>' || line || '>O' || split_part(substr(line, 2), '-', 1) || '>C' || o_custkey as path from p
""")  # fmt: skip
def gr22(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "customer").select(F.col("c_custkey").alias("root"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    stops = flow_stops(spark, d)
    states = R.reach(roots, flow_edges(spark, d), stops, with_parent=True)
    goal = states.join(stops.where("reason = 'source'"), "node", "left_semi")
    return R.paths(states, goal).select(F.col("root").alias("custkey"), F.array_join("path", ">").alias("path"))


@book.query("gr13_context_match", """
select l_orderkey as orderkey, count(distinct l_suppkey) as n_suppliers from lineitem group by 1
""")  # fmt: skip
def gr13(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that an order reaches through the shared callee 'part', returning to its own call site only."""
    lines = table(spark, d, "lineitem")
    site = F.concat(F.lit("O"), "l_orderkey")
    part = F.concat(F.lit("P"), "l_partkey", F.lit("@"), "l_suppkey")
    enter = lines.select(site.alias("node"), part.alias("next"), F.lit("enter").alias("kind"), site.alias("site"))
    leave = lines.select(part.alias("node"), F.concat(F.lit("S"), "l_suppkey", F.lit("/"), site).alias("next"), F.lit("leave").alias("kind"), site.alias("site"))
    roots = table(spark, d, "orders").select(F.col("o_orderkey").alias("root"), F.concat(F.lit("O"), "o_orderkey").alias("node"))
    states = R.reach_in_context(roots, enter.unionByName(leave).distinct())
    found = states.where(F.col("node").startswith("S"))
    return found.groupBy(F.col("root").alias("orderkey")).agg(F.count_distinct(F.element_at(F.split("node", "/"), 1)).alias("n_suppliers"))


@book.query("gr24_bounded_recursive", """
with recursive steps as (
  select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events),
e as (select distinct a, b from steps where a is not null and b is not null),
w(path, cur, depth) as (
  select a, a, 0 from e group by a
  union all
  select w.path || '>' || e.b, e.b, w.depth + 1 from w join e on e.a = w.cur where w.depth < 3)
select path, cast(depth as integer) as depth from w
""")  # fmt: skip
def gr24(spark: SparkSession, d: str) -> DataFrame:
    """All chains of up to four event types; the types are few, so the recursion is bounded."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("a is not null and b is not null").distinct()
    return spark.sql(
        """with recursive w(path, cur, depth) as (
             select a, a, 0 from (select distinct a from {e})
             union all
             select concat(w.path, '>', e.b), e.b, w.depth + 1 from w join {e} e on e.a = w.cur where w.depth < 3)
           select path, depth from w""",
        e=e,
    )


@book.query("gr09_summary_suppress", """
select l_orderkey as orderkey, count(distinct l_suppkey) as n_edges, count(distinct case when l_returnflag <> 'R' then l_suppkey end) as n_kept from lineitem group by 1
""")  # fmt: skip
def gr09(spark: SparkSession, d: str) -> DataFrame:
    """Orders as callees, suppliers as their parameters: calls pass on only what the summary says reaches the result."""
    lines = table(spark, d, "lineitem")
    order, param = F.concat(F.lit("O"), "l_orderkey"), F.concat(F.lit("O"), "l_orderkey", F.lit("/S"), "l_suppkey")
    flows = lines.select(order.alias("node"), _line().alias("next")).unionByName(lines.where("l_returnflag <> 'R'").select(_line().alias("node"), param.alias("next")))
    params = lines.select(order.alias("fn"), F.col("l_suppkey").alias("slot"), param.alias("param")).distinct()
    kept = R.param_summaries(params.select("fn", F.col("fn").alias("ret")).distinct(), params, flows)
    through = params.select(F.col("fn").alias("callee"), "slot")
    per = R.suppressed(through, kept).groupBy("callee").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("n_kept"))
    return per.select(F.substring("callee", 2, 20).cast("bigint").alias("orderkey"), "n_edges", "n_kept")


@book.query("gr05_alias_classes_whole")
def gr05_whole(spark: SparkSession, d: str) -> DataFrame:
    """Orders that may alias over all lines; a closure in SQL would need all pairs of a class."""
    return _alias_classes(table(spark, d, "lineitem"))


def _alias_classes(lines: DataFrame) -> DataFrame:
    e = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    least = e.groupBy("p").agg(F.min("o").alias("next"))
    links = e.join(least, "p").select(F.col("o").alias("node"), "next")
    return R.components(links).select(F.col("node").alias("orderkey"), F.col("component").alias("class"))


@book.query("gr08_levels", """
select 'C' as kind, 0 as level, count(*) as n from customer
union all select 'O', 1, count(*) from orders where exists (select 1 from customer where c_custkey = o_custkey)
union all select 'L', 2, count(distinct (o_orderkey, l_linenumber, l_partkey, l_suppkey)) from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey 
union all select 'S', 3, count(distinct l_suppkey) from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
""")  # fmt: skip
def gr08(spark: SparkSession, d: str) -> DataFrame:
    """Bottom-up levels: how far each kind of vertex is from the sinks, over all of them at once."""
    roots = table(spark, d, "customer").select(F.lit(0).alias("root"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    states = R.reach(roots, flow_edges(spark, d))
    return states.groupBy(F.substring("node", 1, 1).alias("kind"), F.col("depth").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@book.query("gr16_dead_ends", """
with o as (select o_custkey, o_orderkey from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F'),
l as (select o_custkey, l_suppkey from o join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R')
select 'C' as kind, count(*) as n from customer where not exists (select 1 from orders where o_custkey = c_custkey)
union all select 'O', count(*) from o where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
union all select 'S', count(distinct (o_custkey, l_suppkey)) from l left join supplier on s_suppkey = l_suppkey where coalesce(s_acctbal between -800 and 9600, true)
""")  # fmt: skip
def gr16(spark: SparkSession, d: str) -> DataFrame:
    """Where walks end without a source, a stop or a further edge, by kind of vertex."""
    roots = table(spark, d, "customer").select(F.col("c_custkey").alias("root"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    edges, stops = flow_edges(spark, d), flow_stops(spark, d)
    ends = R.dead_ends(R.reach(roots, edges, stops), edges, stops)
    kinds = spark.createDataFrame([("C",), ("O",), ("S",)], "kind string")
    n = ends.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@book.query("win08_first_parent", _WALK + """
select o_custkey as custkey, s_suppkey as suppkey, min('L' || o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) as parent
from l join supplier on s_suppkey = l_suppkey where not sani group by 1, 2
""")  # fmt: skip
def win08(spark: SparkSession, d: str) -> DataFrame:
    """The first parent of each supplier that a walk reaches (WIN-08)."""
    roots = table(spark, d, "customer").select(F.col("c_custkey").alias("root"), F.concat(F.lit("C"), "c_custkey").alias("node"))
    states = R.reach(roots, flow_edges(spark, d), flow_stops(spark, d), with_parent=True)
    return states.where(F.col("node").startswith("S")).select(F.col("root").alias("custkey"), F.substring("node", 2, 20).cast("bigint").alias("suppkey"), "parent")
