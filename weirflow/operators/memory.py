"""Allocation contracts of functions and their misuse, from program tables (AGG-15, CHK-07, CHK-10).

Which functions return fresh memory and which release a parameter is a fixpoint
over the call graph: a function whose returned value comes from an allocator, or
from a function that returns fresh memory, does too. Rounds are joins over all
functions at once, until one changes nothing: the sets only grow, by one
function at least each round.

On sources lowered by tokens, blocks are those of braces: a release counts for
a later use only if its block encloses the use, so exclusive branches never pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from . import reach as R
from .program import Program

#: Functions that return fresh memory, and that release their first argument (fixed values).
ALLOCATORS = ("malloc", "calloc", "realloc", "strdup", "strndup", "aligned_alloc", "xmalloc", "xcalloc", "zmalloc", "g_malloc", "fopen")
RELEASES = ("free", "xfree", "zfree", "g_free", "fclose", "cfree")


@dataclass
class Summaries:
    """fresh (fn) and consumes (fn, slot) at the fixpoint."""

    fresh: DataFrame
    consumes: DataFrame


def _flows(p: Program) -> DataFrame:
    return p.part("edges").where("kind = 'flow'").select("node", "next")


def summaries(p: Program) -> Summaries:
    functions = p.part("functions").select("fn", "ret", "params")
    calls = p.part("calls").where("not again").select("call", "fn", "resolved", "result")
    bound = p.bindings.select("call", F.col("callee").alias("target"))
    args = p.part("args").where("node is not null and slot >= 0").select("call", "slot", "node")
    flows = write_table(_flows(p), "flows")
    # what each returned value and each argument is made of, within its function
    made = write_table(R.reach(functions.select(F.col("fn").alias("root"), F.col("ret").alias("node")), flows).select(F.col("root").alias("fn"), "node"), "made")
    origin = made.join(calls.select(F.col("result").alias("node"), "call", "resolved"), "node").join(bound, "call", "left")
    origin = write_table(origin.select("fn", "resolved", "target"), "origin")
    params = functions.select("fn", F.posexplode("params").alias("slot", "param"))
    backs = R.reach(args.select(F.concat_ws("|", "call", "slot").alias("root"), "node"), flows)
    given = backs.join(params, backs.node == params.param).select(F.substring_index("root", "|", 1).alias("call"), F.substring_index("root", "|", -1).cast("int").alias("at"), "fn", "slot")
    given = write_table(given.join(calls.select("call", "resolved"), "call").join(bound, "call", "left").select("fn", "slot", "at", "resolved", "target"), "given")
    fresh = write_table(origin.where(F.col("resolved").isin(*ALLOCATORS)).select("fn").distinct(), "fresh")
    consumes = write_table(given.where(F.col("resolved").isin(*RELEASES) & (F.col("at") == 0)).select("fn", "slot").distinct(), "consumes")
    while True:
        more = origin.join(fresh.select(F.col("fn").alias("target")), "target").select("fn").distinct().join(fresh, "fn", "left_anti")
        far = given.join(consumes.select(F.col("fn").alias("target"), F.col("slot").alias("at")), ["target", "at"]).select("fn", "slot").distinct().join(consumes, ["fn", "slot"], "left_anti")
        more, far = write_table(more, "fresh"), write_table(far, "consumes")
        if more.isEmpty() and far.isEmpty():
            return Summaries(fresh, consumes)
        fresh, consumes = fresh.unionByName(more), consumes.unionByName(far)

def _events(p: Program, s: Summaries) -> tuple[DataFrame, DataFrame]:
    """Allocating calls and releasing ones: call, fn, file, family, line, block, idx, doms, node."""
    calls = p.part("calls").where("not again").select("call", "fn", "file", "family", "resolved", "result", "line", "block", "idx", "doms")
    bound = p.bindings.select("call", F.col("callee").alias("target"))
    args = p.part("args").where("node is not null and slot >= 0").select("call", "slot", "node")
    all_ = calls.join(bound, "call", "left")
    by_name = F.col("resolved").isin(*ALLOCATORS)
    allocs = all_.join(s.fresh.select(F.col("fn").alias("target"), F.lit(True).alias("_f")), "target", "left").where(by_name | F.col("_f")).withColumn("node", F.col("result"))
    consumed = s.consumes.select(F.col("fn").alias("target"), "slot", F.lit(True).alias("_c"))
    frees = all_.join(args, "call").join(consumed, ["target", "slot"], "left").where((F.col("resolved").isin(*RELEASES) & (F.col("slot") == 0)) | F.col("_c"))
    columns = ["call", "fn", "file", "family", "line", "block", "idx", "doms", "node"]
    return allocs.select(columns), frees.select(columns)


def misuse(p: Program, s: Summaries | None = None) -> DataFrame:
    """rule, family, file, fn, line: double releases, uses after release, leaks."""
    s = s or summaries(p)
    allocs, frees = (write_table(x, "memory") for x in _events(p, s))
    args = p.part("args").where("node is not null").select("call", "node")
    calls = p.part("calls").where("not again").select("call", "fn", "file", "family", F.col("line").alias("at"), F.col("block").alias("b"), F.col("idx").alias("i"), F.col("doms").alias("d"))
    uses = args.join(calls, "call").withColumnRenamed("call", "use")
    pairs = frees.select("call", "fn", "node", "block", "idx").join(uses, ["fn", "node"])
    later = pairs.where((F.col("use") != F.col("call")) & (F.col("idx") < F.col("i")) & F.array_contains("d", F.col("block")))
    again = frees.select(F.col("call").alias("use"), F.lit(True).alias("_free")).distinct()
    late = later.join(again, "use", "left").select(F.when(F.col("_free"), "double_free").otherwise("use_after_free").alias("rule"), "family", "file", "fn", F.col("at").alias("line"))
    # whatever an allocation flows into: returned, stored or given to any call, it may live on
    forward = p.part("edges").where("kind <> 'through'").select(F.col("next").alias("node"), F.col("node").alias("next"))
    reached = R.reach(allocs.select(F.col("call").alias("root"), "node"), forward).select(F.col("root").alias("call"), "node")
    returns = p.part("nodes").where("kind in ('return', 'param')").select("node")
    kept = reached.join(returns, "node", "left_semi").select("call").unionByName(reached.join(args.select("node").distinct(), "node", "left_semi").select("call")).distinct()
    leaks = allocs.join(kept, "call", "left_anti").select(F.lit("memory_leak").alias("rule"), "family", "file", "fn", "line")
    return late.unionByName(leaks).distinct()
