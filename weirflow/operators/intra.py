"""Analyses within a function over control-flow tables (GR-01, 02, 05..07, 23, AGG-18, CHK-07, 08, 10).

Blocks and instructions come as rows. They are partitioned and sorted by
function, and each function is analysed when its last row has come, so a task
holds one function at a time and no group costs a call of its own.
Loops over lattices of finite height run to their end. Only intervals can widen
without end, so those have a cap; a function that hits it says so in
``converged``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

LOW, HIGH = -(2**63), 2**63 - 1
#: Result rows that are sent at a time.
OUT_ROWS = 20_000


def per_function(rows: DataFrame, order: Sequence[str], analyse: Callable[[list[tuple]], Iterable[tuple]], result: str) -> DataFrame:
    """``analyse`` on the rows (all columns but the first, fn) of each function; fn is put before its result rows.

    ``order`` sorts the rows within a function; null functions are one.
    """
    kind = to_arrow_schema(_parse_datatype_string(f"fn string, {result}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, held, out = None, [], []

        def send() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

        for batch in batches:
            for name, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and name != fn:
                    out += [(fn, *r) for r in analyse(held)]
                    held = []
                    if len(out) >= OUT_ROWS:
                        yield send()
                        out.clear()
                fn = name
                held.append(tuple(row))
        if held:
            out += [(fn, *r) for r in analyse(held)]
        yield send()

    return rows.repartition("fn").sortWithinPartitions("fn", *order).mapInArrow(run, f"fn string, {result}")


def _edges(cfg: DataFrame, *more: Column) -> DataFrame:
    """Control-flow edges as rows fn, block, dst and ``more``."""
    return cfg.select("fn", F.col("src").cast("long").alias("block"), F.col("dst").cast("long").alias("dst"), *more)


def idoms(succ: dict[int, list[int]], entry: int) -> dict[int, int]:
    """Immediate dominators of the reachable blocks, by intersecting along reverse post-order."""
    order: list[int] = []
    seen, stack = {entry}, [(entry, iter(succ.get(entry, [])))]
    while stack:
        b, it = stack[-1]
        for n in it:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(succ.get(n, []))))
                break
        else:
            order.append(b)
            stack.pop()
    order.reverse()
    place = {b: i for i, b in enumerate(order)}
    preds = defaultdict(list)
    for b in order:
        for n in succ.get(b, []):
            preds[n].append(b)
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = None
            for p in preds[b]:
                if p in idom:
                    a = p
                    while new is not None and a != new:
                        while place[a] > place[new]:
                            a = idom[a]
                        while place[new] > place[a]:
                            new = idom[new]
                    new = a
            if idom.get(b) != new:
                idom[b], changed = new, True
    return idom


def dominators(blocks: DataFrame, cfg: DataFrame, entry: int = 0) -> DataFrame:
    """fn, block, dom: each block's dominators, itself among them; an unreachable block has all."""
    rows = blocks.select("fn", F.col("block").cast("long"), F.lit(None).cast("long").alias("dst")).unionByName(_edges(cfg))

    def one(rows: list[tuple]) -> Iterator[tuple]:
        every = sorted({x for r in rows for x in r if x is not None})
        succ = defaultdict(list)
        for b, d in rows:
            if d is not None:
                succ[b].append(d)
        idom = idoms(succ, entry)
        for b in every:
            if b not in idom:
                yield from ((b, d) for d in every)
                continue
            up = b
            yield b, up
            while idom[up] != up:
                up = idom[up]
                yield b, up

    return per_function(rows, ["block", "dst"], one, "block long, dom long")


def frontiers(succ: dict[int, list[int]], entry: int) -> dict[int, set[int]]:
    """Dominance frontiers, where phis go."""
    idom = idoms(succ, entry)
    preds = defaultdict(list)
    for b, ns in succ.items():
        for n in ns:
            preds[n].append(b)
    out: dict[int, set[int]] = defaultdict(set)
    for b, ps in preds.items():
        if len(ps) > 1 and b in idom:
            for p in ps:
                while p in idom and p != idom[b]:
                    out[p].add(b)
                    if p == idom[p]:
                        break
                    p = idom[p]
    return out


def phi_places(defs: DataFrame, cfg: DataFrame, entry: int = 0) -> DataFrame:
    """fn, var, block of the phis of SSA form: ``defs`` (fn, block, var) closed under frontiers."""
    rows = defs.select("fn", F.col("block").cast("long"), F.lit(None).cast("long").alias("dst"), "var").unionByName(_edges(cfg, F.lit(None).cast("string").alias("var")))

    def one(rows: list[tuple]) -> Iterator[tuple]:
        succ, places = defaultdict(list), defaultdict(list)
        for b, d, var in rows:
            if d is not None:
                succ[b].append(d)
            else:
                places[var].append(b)
        front = frontiers(succ, entry)
        for var, work in sorted(places.items()):
            out = set()
            while work:
                for f in front.get(work.pop(), ()):
                    if f not in out:
                        out.add(f)
                        work.append(f)
            yield from ((var, f) for f in sorted(out))

    return per_function(rows, ["block", "dst"], one, "var string, block long")


def _sat(x: int) -> int:
    return max(LOW, min(HIGH, x))


def _arith(op: str, a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int] | None:
    if op == "+":
        return _sat(a[0] + b[0]), _sat(a[1] + b[1])
    if op == "-":
        return _sat(a[0] - b[1]), _sat(a[1] - b[0])
    if op == "*":
        c = [x * y for x in a for y in b]
        return _sat(min(c)), _sat(max(c))
    return None


def _clip(v: tuple[int, int] | None, low: int, high: int) -> tuple[int, int]:
    base = v or (LOW, HIGH)
    new = max(base[0], low), min(base[1], high)
    return new if new[0] <= new[1] else base


_NEGATED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}


def _sharpen(state: dict, var: str, op: str, k: int) -> dict:
    v = state.get(var)
    clip = {"<": (LOW, k - 1), "<=": (LOW, k), ">": (k + 1, HIGH), ">=": (k, HIGH), "==": (k, k)}.get(op)
    return {**state, var: _clip(v, *clip)} if clip else state


def value_intervals(instrs: DataFrame, branches: DataFrame, cfg: DataFrame, entry: int = 0) -> DataFrame:
    """fn, block, var, low, high, converged: intervals at the end of each block (GR-23).

    ``instrs`` (fn, block, idx, dest, op, a, b): op 'const' (a is the number),
    'copy' (a is a variable), '+', '-', '*' (variables or numbers as text), anything
    else defines an unknown. ``branches`` (fn, block, var, op, k, on_true, on_false)
    sharpen along edges. A variable without a row can be anything.
    """
    lit = lambda v, t="string": F.lit(v).cast(t)
    parts = [
        instrs.select("fn", lit("i").alias("kind"), F.col("block").cast("long"), F.col("idx").cast("long"), "dest", "op", F.col("a").cast("string"), F.col("b").cast("string"), lit(None, "long").alias("x"), lit(None, "long").alias("y")),
        branches.select("fn", lit("b").alias("kind"), F.col("block").cast("long"), F.col("k").cast("long").alias("idx"), F.col("var").alias("dest"), "op", lit(None).alias("a"), lit(None).alias("b"), F.col("on_true").cast("long").alias("x"), F.col("on_false").cast("long").alias("y")),
        cfg.select("fn", lit("e").alias("kind"), F.col("src").cast("long").alias("block"), lit(None, "long").alias("idx"), lit(None).alias("dest"), lit(None).alias("op"), lit(None).alias("a"), lit(None).alias("b"), F.col("dst").cast("long").alias("x"), lit(None, "long").alias("y")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def one(rows: list[tuple]) -> Iterator[tuple]:
        body, succ, branch = defaultdict(list), defaultdict(list), {}
        for kind, block, idx, dest, op, a, b, x, y in rows:
            if kind == "i":
                body[block].append((dest, op, a, b))
            elif kind == "e":
                succ[block].append(x)
            else:
                branch[block] = (dest, op, idx, x, y)
        blocks = {entry, *body, *succ, *(d for ds in succ.values() for d in ds)}
        ins: dict[int, dict | None] = dict.fromkeys(blocks)
        ins[entry] = {}
        outs: dict[int, dict] = {}
        work, steps, cap = [entry], 0, 64 * (len(blocks) + 1)

        def value(state: dict, t: str | None) -> tuple[int, int] | None:
            if t is None:
                return None
            return (int(t), int(t)) if t.lstrip("-").isdigit() else state.get(t)

        while work and steps < cap:
            steps += 1
            b = work.pop(0)
            state = dict(ins[b] or {})
            for dest, op, p, q in body[b]:
                v = value(state, p) if op in ("const", "copy") else None
                if op in ("+", "-", "*"):
                    x, y = value(state, p), value(state, q)
                    v = _arith(op, x, y) if x and y else None
                state.pop(dest, None)
                if v is not None:
                    state[dest] = v
            outs[b] = state
            for n in succ[b]:
                s = state
                if b in branch:
                    var, op, k, t, f = branch[b]
                    s = _sharpen(state, var, op if n == t else _NEGATED.get(op, ""), k) if t != f else state
                old = ins[n]
                new = dict(s) if old is None else {v: (min(old[v][0], s[v][0]), max(old[v][1], s[v][1])) for v in old if v in s}
                if new != old:
                    ins[n] = new
                    if n not in work:
                        work.append(n)
        for b, s in sorted(outs.items()):
            for v, (lo, hi) in sorted(s.items()):
                yield b, v, lo, hi, not work

    return per_function(rows, ["block", "idx"], one, "block long, var string, low long, high long, converged boolean")


def points_to(constraints: DataFrame) -> DataFrame:
    """fn, var, loc: inclusion constraints, field-sensitive (GR-06).

    ``constraints`` (fn, op, dest, src, field): 'alloc' dest at src, 'copy' dest
    from src, 'store' dest.field from src, 'load' dest from src.field; a field '*'
    is any. Sets only grow and are bounded by the function's locations, so the
    passes end by themselves.
    """

    def one(rows: list[tuple]) -> Iterator[tuple]:
        pts, heap = defaultdict(set), defaultdict(set)
        for op, dest, src, _ in rows:
            if op == "alloc":
                pts[dest].add(src)
        before, now = -1, 0
        while now != before:
            before = now
            for op, dest, src, field in rows:
                if op == "copy":
                    pts[dest] |= pts[src]
                elif op == "store":
                    for loc in pts[dest]:
                        heap[loc, field] |= pts[src]
                elif op == "load":
                    for loc in list(pts[src]):
                        for f in [f for at, f in list(heap) if at == loc] if field == "*" else [field, "*"]:
                            pts[dest] |= heap[loc, f]
            now = sum(map(len, pts.values())) + sum(map(len, heap.values()))
        yield from sorted((v, loc) for v, ls in pts.items() for loc in ls)

    return per_function(constraints.select("fn", "op", "dest", "src", "field"), ["op", "dest", "src"], one, "var string, loc string")


def lifetimes(events: DataFrame, cfg: DataFrame, entry: int = 0) -> DataFrame:
    """fn, rule, loc, block, idx: use after free, double free, uninitialised free, leaks (CHK-07, CHK-10).

    ``events`` (fn, block, idx, op, loc): 'alloc', 'free', 'use', 'escape', 'exit'.
    A finding of the first three needs the free on every path (may-live states
    are kept apart), a leak needs a location that may still live at an exit.
    """
    rows = events.select("fn", F.col("block").cast("long"), F.col("idx").cast("long"), "op", "loc", F.lit(None).cast("long").alias("dst")).unionByName(
        cfg.select("fn", F.col("src").cast("long").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit("edge").alias("op"), F.lit(None).cast("string").alias("loc"), F.col("dst").cast("long"))
    )

    def one(rows: list[tuple]) -> Iterator[tuple]:
        body, succ = defaultdict(list), defaultdict(list)
        for block, idx, op, loc, dst in rows:
            (succ[block].append(dst) if op == "edge" else body[block].append((idx, op, loc)))
        locs = sorted({x for es in body.values() for _, _, x in es if isinstance(x, str)})
        fresh = frozenset({"none"})
        ins: dict[int, dict] = {entry: dict.fromkeys(locs, fresh)}
        work, found = [entry], set()
        # the sets of states only grow, so the list runs empty
        while work:
            b = work.pop(0)
            s = dict(ins[b])
            for _, op, loc in body[b]:
                if op == "alloc":
                    s[loc] = frozenset({"live"})
                elif op in ("free", "escape"):
                    s[loc] = frozenset({"freed" if op == "free" else "gone"})
            for n in succ[b]:
                old = ins.get(n)
                new = s if old is None else {x: old[x] | s[x] for x in locs}
                if new != old:
                    ins[n] = dict(new)
                    if n not in work:
                        work.append(n)
        for b in sorted(ins):
            s = dict(ins[b])
            for i, op, loc in body[b]:
                if op == "use" and s[loc] == {"freed"}:
                    found.add(("use_after_free", loc, b, i))
                elif op == "free" and s[loc] == {"freed"}:
                    found.add(("double_free", loc, b, i))
                elif op == "free" and s[loc] == {"none"}:
                    found.add(("uninitialized_free", loc, b, i))
                elif op == "exit":
                    found |= {("memory_leak", x, b, i) for x in locs if "live" in s[x]}
                if op == "alloc":
                    s[loc] = frozenset({"live"})
                elif op in ("free", "escape"):
                    s[loc] = frozenset({"freed" if op == "free" else "gone"})
        yield from sorted(found)

    return per_function(rows, ["block", "idx"], one, "rule string, loc string, block long, idx long")


def must_hold(facts: DataFrame, cfg: DataFrame, entry: int = 0) -> DataFrame:
    """fn, block, fact: what holds at the end of a block on every path to it (AGG-18).

    ``facts`` (fn, block, fact, holds): a block that makes a fact hold, or ends
    it. A block's facts are those of all its predecessors, changed by its own; an
    unreachable block has none.
    """
    rows = facts.select("fn", F.col("block").cast("long"), F.lit(None).cast("long").alias("dst"), "fact", "holds").unionByName(_edges(cfg, F.lit(None).cast("string").alias("fact"), F.lit(None).cast("boolean").alias("holds")))

    def one(rows: list[tuple]) -> Iterator[tuple]:
        succ, made, ended = defaultdict(list), defaultdict(set), defaultdict(set)
        for b, d, fact, holds in rows:
            if d is not None:
                succ[b].append(d)
            elif fact is not None:
                (made if holds else ended)[b].add(fact)
        ins, work = {entry: frozenset()}, [entry]
        while work:
            b = work.pop(0)
            out = frozenset((ins[b] - ended[b]) | made[b])
            for n in succ[b]:
                new = ins[n] & out if n in ins else out
                if n not in ins or new != ins[n]:
                    ins[n] = new
                    if n not in work:
                        work.append(n)
        for b in sorted(ins):
            yield from ((b, f) for f in sorted((ins[b] - ended[b]) | made[b]))

    return per_function(rows, ["block", "dst", "fact"], one, "block long, fact string")


def out_of_bounds(accesses: DataFrame, intervals: DataFrame, capacities: DataFrame) -> DataFrame:
    """Accesses (fn, block, buffer, index) whose interval leaves the least capacity (CHK-08).

    Unknown intervals and capacities say nothing.
    """
    cap = capacities.groupBy("fn", "buffer").agg(F.min("capacity").alias("capacity"))
    at = accesses.join(cap, ["fn", "buffer"]).join(intervals.select("fn", "block", F.col("var").alias("index"), "low", "high"), ["fn", "block", "index"])
    rule = F.when(F.col("low") < 0, "negative_access").when(F.col("high") >= F.col("capacity"), "out_of_bounds_access")
    return at.withColumn("rule", rule).where("rule is not null")
