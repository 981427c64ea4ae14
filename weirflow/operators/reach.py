"""Set-at-a-time reachability over edge tables (GR-10, 11, 13, 14, 16, 22).

All roots walk together: the frontier is one table of states, each round joins
it with the edges, drops what was visited, and is written to the shared folder,
so the lineage stays flat and no graph is ever collected. A state is (root,
node) plus, with ``context``, the chain of call sites entered.

Defined cases: a root without edges is a state of its own; cycles end, as
states are visited once; null nodes never join; repeated edges count once;
``max_rounds`` reached with states left raises, as a cut-off walk must not look
complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import MAX_BROADCAST_BYTES, Written, write_counted, write_table

#: Edges up to which they are broadcast to the frontier, and new states up to which they are to those visited (64 MB each at most).
MAX_BROADCAST_EDGES = 1_000_000
#: Depth of call-site chains; a deeper chain is forgotten (context-free from there), which ``context_lost`` of the state says.
MAX_CONTEXT = 8
#: Steps back that paths take between two writes.
PATH_STEPS = 4


class Visited:
    """The states seen so far, as few written tables.

    New tables are merged four by four of one rank, so a state is written again
    as often as the logarithm of the rounds, and there are never many tables.
    """

    def __init__(self, state: Sequence[str]) -> None:
        self.state, self.tables = list(state), []

    def add(self, new: Written) -> None:
        self.tables.append((0, new))
        while len(self.tables) >= 4 and len({rank for rank, _ in self.tables[-4:]}) == 1:
            rank, last = self.tables[-1][0], [w for _, w in self.tables[-4:]]
            merged = write_table(reduce(DataFrame.unionByName, [w.df for w in last]).coalesce(max(1, sum(w.rows for w in last) // 1_000_000 + 1)), "reach")
            self.tables[-4:] = [(rank + 1, Written(merged, sum(w.rows for w in last), sum(w.bytes for w in last), 0))]

    @property
    def df(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [w.df for _, w in self.tables])

    def unseen(self, step: DataFrame) -> DataFrame:
        """The states of ``step`` that were not seen.

        Few visited states go to the new ones; else few new ones, written once, go
        to the visited, which then need no shuffle; else both are shuffled.
        """
        seen = self.df.select(*self.state)
        if sum(w.rows for _, w in self.tables) <= MAX_BROADCAST_EDGES and sum(w.bytes for _, w in self.tables) <= MAX_BROADCAST_BYTES:
            return step.join(F.broadcast(seen), self.state, "left_anti")
        held = write_counted(step, "step")
        if held.fits(MAX_BROADCAST_EDGES):
            seen = seen.join(F.broadcast(held.df.select(*self.state)), self.state, "left_semi")
        return held.df.join(seen, self.state, "left_anti")


def reach(roots: DataFrame, edges: DataFrame, stops: DataFrame | None = None, max_rounds: int = 200, with_parent: bool = False) -> DataFrame:
    """All states (root, node, depth[, parent]) reached from ``roots`` (root, node).

    ``edges`` (node, next) are followed from node to next; nodes of ``stops``
    (node) are reached but not left. With ``with_parent`` a state names the
    least node among those it was first reached from.
    """
    kept = ["root", "node", "depth"] + ["parent"] * with_parent
    start = roots.select("root", "node").distinct().withColumn("depth", F.lit(0))
    if with_parent:
        start = start.withColumn("parent", F.lit(None).cast(roots.schema["node"].dataType))
    walked = edges.select("node", F.col("next").alias("_to")).where("node is not null and _to is not null").distinct()
    if stops is not None:
        walked = walked.join(stops.select("node").distinct(), "node", "left_anti")
    walked = write_counted(walked, "edges")
    walked = F.broadcast(walked.df) if walked.fits(MAX_BROADCAST_EDGES) else walked.df
    new = write_counted(start.select(kept), "reach")
    seen, frontier = Visited(["root", "node"]), new.df

    def step(states: DataFrame, depth: int) -> DataFrame:
        to = states.select("root", "node").join(walked, "node").select("root", F.col("_to").alias("node"), F.col("node").alias("_from"))
        to = to.groupBy("root", "node").agg(F.min("_from").alias("parent")) if with_parent else to.select("root", "node").distinct()
        return to.withColumn("depth", F.lit(depth)).select(kept)

    # two steps a round: what the first one finds again leads to nothing new in the second
    for depth in range(1, max_rounds + 1, 2):
        seen.add(new)
        one = step(frontier, depth)
        both = one.unionByName(step(one, depth + 1)).groupBy("root", "node").agg(F.min(F.struct(*kept[2:])).alias("_d")).select("root", "node", "_d.*")
        last = F.col("depth") == depth + 1
        new = write_counted(seen.unseen(both).select(kept), "reach", last)
        if not new.marked:
            seen.add(new)
            return seen.df
        frontier = new.df.where(last)
    raise RuntimeError(f"states left after {max_rounds} rounds")


def reach_in_context(roots: DataFrame, edges: DataFrame, stops: DataFrame | None = None, carry: Sequence[str] = (), max_rounds: int = 400) -> DataFrame:
    """Reachability that leaves a callee only to the site it was entered from.

    ``edges`` (node, next, kind, site): kind 'enter' steps from a call's result
    into the callee and pushes its site, 'leave' steps from a parameter to the
    argument of a call and needs that site on top (or an empty chain), 'jump'
    forgets the chain, anything else stays in the function. ``carry`` names
    columns of the roots that states keep; ``stops`` holds node and any of them
    on which a stop depends. States: root, carry..., node, ctx, depth, parent,
    context_lost (the chain had grown beyond MAX_CONTEXT on the way here).
    """
    empty = F.array().cast("array<string>")
    state = ["root", *carry, "node", "ctx"]
    none = F.lit(None).cast("string")
    new = write_counted(roots.select("root", *carry, "node").distinct().withColumns({"ctx": empty, "depth": F.lit(0), "parent": none, "context_lost": F.lit(False)}), "reach")
    walked = write_counted(edges.where("node is not null and next is not null").select("node", F.col("next").alias("_to"), "kind", "site").distinct(), "edges")
    walked = F.broadcast(walked.df) if walked.fits(MAX_BROADCAST_EDGES) else walked.df
    ends = None if stops is None else write_table(stops.distinct(), "stops")
    seen, frontier = Visited(state), new.df
    top = F.try_element_at("ctx", F.lit(-1))
    after = (
        F.when(F.col("kind") == "enter", F.when(F.size("ctx") < MAX_CONTEXT, F.concat("ctx", F.array("site"))).otherwise(empty))
        .when(F.col("kind") == "leave", F.when(F.size("ctx") > 0, F.slice("ctx", F.lit(1), F.size("ctx") - 1)).otherwise(empty))
        .when(F.col("kind") == "jump", empty)
        .otherwise(F.col("ctx"))
    )

    def step(states: DataFrame, depth: int) -> DataFrame:
        going = states if ends is None else states.join(ends, ends.columns, "left_anti")
        hit = going.join(walked, "node").where((F.col("kind") != "leave") | (F.size("ctx") == 0) | (top == F.col("site")))
        lost = F.col("context_lost") | ((F.col("kind") == "enter") & (F.size("ctx") >= MAX_CONTEXT))
        to = hit.select("root", *carry, F.col("_to").alias("node"), after.alias("ctx"), F.col("node").alias("_from"), F.coalesce(lost, F.lit(False)).alias("context_lost"))
        return to.groupBy(*state).agg(F.min("_from").alias("parent"), F.max("context_lost").alias("context_lost")).withColumn("depth", F.lit(depth))

    # two steps a round: what the first one finds again leads to nothing new in the second
    for depth in range(1, max_rounds, 2):
        seen.add(new)
        one = step(frontier, depth)
        both = one.unionByName(step(one, depth + 1)).groupBy(*state).agg(F.min(F.struct("depth", "parent", "context_lost")).alias("_d")).select(*state, "_d.*")
        last = F.col("depth") == depth + 1
        new = write_counted(seen.unseen(both).select(*state, "depth", "parent", "context_lost"), "reach", last)
        frontier = new.df.where(last)
        if not new.marked:
            seen.add(new)
            return seen.df
    raise RuntimeError(f"states left after {max_rounds} steps")


def dead_ends(states: DataFrame, edges: DataFrame, stops: DataFrame) -> DataFrame:
    """The states (root, node, ...) that no stop ends and no edge leaves (GR-16)."""
    return states.join(stops.select("node").distinct(), "node", "left_anti").join(edges.where("next is not null").select("node").distinct(), "node", "left_anti")


def param_summaries(returns: DataFrame, params: DataFrame, flows: DataFrame) -> DataFrame:
    """fn, slot: the parameters whose value reaches what their function returns (AGG-16, GR-09).

    ``returns`` (fn, ret), ``params`` (fn, slot, param), ``flows`` (node, next)
    within functions, from a value to what it is made of.
    """
    made = reach(returns.select(F.col("fn").alias("root"), F.col("ret").alias("node")), flows)
    return made.select(F.col("root").alias("fn"), F.col("node").alias("param")).join(params, ["fn", "param"]).select("fn", "slot").distinct()


def suppressed(through: DataFrame, summaries: DataFrame) -> DataFrame:
    """``through`` (callee, slot, ...: an argument taken to pass into its call's result) with ``kept``.

    A callee's own summary says which slots pass; where it names none, none does.
    """
    s = summaries.select(F.col("fn").alias("callee"), "slot", F.lit(True).alias("_k")).distinct()
    return through.join(s, ["callee", "slot"], "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")


def verdict(source: Column, unknown: Column, sanitized: Column) -> Column:
    """The verdict of a group of states, in this order of precedence (AGG-01)."""
    return (
        F.when(F.max(F.coalesce(source, F.lit(False))), "vulnerable")
        .when(F.max(F.coalesce(unknown, F.lit(False))), "unknown")
        .when(F.max(F.coalesce(sanitized, F.lit(False))), "sanitized")
        .otherwise("clean")
    )


def paths(states: DataFrame, goal: DataFrame) -> DataFrame:
    """For each (root, node) of ``goal`` the nodes from there back to the root, as an array.

    ``states`` are those of ``reach(..., with_parent=True)``: a parent is less
    deep than its state, so as many rounds as the deepest goal has steps end every path.
    """
    parent = write_counted(states.select("root", F.col("node").alias("_at"), F.col("parent").alias("_up")).distinct(), "parents")
    parent = F.broadcast(parent.df) if parent.fits(MAX_BROADCAST_EDGES) else parent.df
    first = goal.select("root", "node").distinct().join(states.select("root", "node", "parent"), ["root", "node"])
    new = write_counted(first.select("root", F.col("node").alias("goal"), F.array("node").alias("path"), F.col("parent").alias("at")), "paths", F.col("at").isNotNull())
    done = [new.df.where("at is null").select("root", "goal", "path")]
    while new.marked:
        open_ = new.df.where("at is not null")
        for _ in range(PATH_STEPS):
            up = open_.alias("o").join(parent.alias("p"), (F.col("o.root") == F.col("p.root")) & (F.col("o.at") == F.col("p._at")), "left")
            open_ = up.select("o.root", "o.goal", F.when(F.col("o.at").isNotNull(), F.concat("o.path", F.array("o.at"))).otherwise(F.col("o.path")).alias("path"), F.col("p._up").alias("at"))
        new = write_counted(open_, "paths", F.col("at").isNotNull())
        done.append(new.df.where("at is null").select("root", "goal", "path"))
    return reduce(DataFrame.unionByName, done)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of an undirected graph (GR-05's classes).

    Large-star and small-star rounds: each moves links to the least neighbour,
    so the rounds grow with the logarithm of a component's width.
    """
    pairs = edges.select(F.col("node").alias("u"), F.col("next").alias("v")).where("u is not null and v is not null").distinct()
    nodes = write_table(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v"))).distinct(), "nodes")
    links = write_table(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").union(low.select("u", "m")).distinct()
        now = write_table(small.toDF("u", "v"), "links")
        same = now.exceptAll(links).isEmpty() and links.exceptAll(now).isEmpty()
        links = now
        if same:
            break
    else:
        raise RuntimeError(f"links still move after {max_rounds} rounds")
    found = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes.node == found.u, "left").select("node", F.coalesce("component", "node").alias("component"))
