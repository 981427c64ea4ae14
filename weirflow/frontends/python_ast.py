"""Python, by the standard parser.

Each function is walked once in program order with an environment of reaching
definitions; branches fork it and join it again, loops are walked twice, so the
values of a later round reach the earlier uses. Conditions that are constant
only lower the arm that is taken. Blocks form a tree of dominators: a join
after a branch one arm of which leaves the function hangs below the other arm.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

_COMPARE_CUT = (ast.Compare,)
#: Calls that put their arguments into the receiver (fixed values).
MUTATORS = frozenset("append push add extend unshift insert set write update setdefault appendleft".split())
_RECEIVERS = ("self", "cls")
UNKNOWN = object()


@dataclass
class Value:
    """What an expression gives: the nodes it is made of, a constant, a dotted path, objects."""

    nodes: tuple[str, ...] = ()
    const: object = UNKNOWN
    path: str = ""
    objects: frozenset[str] = frozenset()
    elements: tuple[Value, ...] | None = None


@dataclass
class Object:
    """An allocation of this function: its node, what its known fields hold, its class."""

    node: str
    fields: dict[str, list[str]] = field(default_factory=dict)
    cls: str = ""
    open: bool = False


class Module:
    """Lowers one file."""

    def __init__(self, path: str, source: str = "", tree: ast.Module | None = None, module: str | None = None) -> None:
        """``tree`` and ``module`` (the file's dotted name) come from other parsers that give the same nodes."""
        self.path = path
        self.out: dict[str, list] = {k: [] for k in ("functions", "nodes", "edges", "calls", "args", "imports")}
        self.aliases: dict[str, str] = {}
        self.defs: dict[str, dict[str, list[str]]] = {}
        self.free: list[tuple[str, str, str]] = []
        self.parents: dict[str, str] = {}
        self.local_functions: set[str] = set()
        self.lines: dict[str, int] = {}
        self.module = module or module_name(path)
        tree = tree or ast.parse(source)
        self._imports(tree)
        self._names(tree, "")
        Function(self, "<module>", None, tree.body, "", 1).run()
        self._closures()

    def _imports(self, tree: ast.AST) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    local = a.asname or a.name.split(".")[0]
                    self.aliases[local] = a.name if a.asname else local
                    self.out["imports"].append({"local": local, "package": a.name, "symbol": None})
            elif isinstance(n, ast.ImportFrom):
                base = n.module or ""
                if n.level:
                    up = self.module.split(".")[: -n.level]
                    base = ".".join([*up, base] if base else up)
                for a in n.names:
                    local = a.asname or a.name
                    self.aliases[local] = f"{base}.{a.name}" if base else a.name
                    self.out["imports"].append({"local": local, "package": base, "symbol": a.name})

    def _names(self, node: ast.AST, prefix: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if not isinstance(n, ast.ClassDef):
                    self.local_functions.add(prefix + n.name)
                self._names(n, f"{prefix}{n.name}.")
            else:
                self._names(n, prefix)

    def _closures(self) -> None:
        """Free names to the nearest enclosing function that defines them."""
        for fn, name, node in self.free:
            at = self.parents.get(fn, "")
            for _ in range(32):
                if not at or name in self.defs.get(at, {}):
                    break
                at = self.parents.get(at, "")
            for d in self.defs.get(at, {}).get(name, []) if at else []:
                self.out["edges"].append({"node": node, "next": d, "kind": "jump", "site": None})


def module_name(path: str) -> str:
    parts = path.rsplit(".", 1)[0].strip("/").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


class Function:
    """Lowers one function body; nested functions are lowered where they stand."""

    def __init__(self, module: Module, qual: str, args: ast.arguments | None, body: list[ast.stmt], enclosing: str, line: int, guards: list[str] | None = None, cls: str = "") -> None:
        # a twin of the same name gets its line; a body that a loop walks again is lowered once
        self.known = module.lines.get(qual) == line
        if module.lines.setdefault(qual, line) != line:
            qual = f"{qual}@{line}"
        self.m, self.qual, self.body, self.cls = module, qual, body, cls
        self.fn = f"{module.path}::{qual}"
        self.enclosing = enclosing
        module.parents[self.fn] = enclosing
        module.defs.setdefault(self.fn, {})
        self.env: dict[str, Value] = {}
        self.objects: dict[str, Object] = {}
        self.n = self.calls = self.branches = self.instructions = 0
        self.block, self.blocks, self.parent = 0, 1, {0: -1}
        self.idx = 0
        self.safe: list[tuple[frozenset[str], str, int]] = []
        self.done = False
        self.in_test = False
        self.again = 0
        if self.known:
            return
        self.guards, self.line = guards or [], line
        self.ret = self.node("return", "", line)
        self.params: list[str] = []
        if args is not None:
            for a in [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]:
                p = self.node("param", a.arg, a.lineno)
                self.params.append(p)
                self.bind(a.arg, Value((p,), path=a.arg))
            for d in [*args.defaults, *[k for k in args.kw_defaults if k]]:
                self.eval(d)

    def run(self) -> None:
        if self.known:
            return
        self.walk(self.body)
        self.m.out["functions"].append(
            {"fn": self.fn, "qual": self.qual, "line": self.line, "params": self.params, "ret": self.ret, "enclosing": self.enclosing or None, "guards": self.guards, "branches": self.branches, "instructions": self.instructions}
        )

    # ---- tables

    def node(self, kind: str, path: str, line: int, preds: tuple[str, ...] = (), edge: str = "flow") -> str:
        name = f"{self.fn}#{self.n}"
        self.n += 1
        self.m.out["nodes"].append({"node": name, "fn": self.fn, "kind": kind, "path": path, "line": line, "block": self.block if self.n > 1 else 0})
        self.link(name, preds, edge)
        return name

    def link(self, node: str, preds: tuple[str, ...], kind: str = "flow", site: str | None = None) -> None:
        for p in dict.fromkeys(preds):
            if p != node:
                self.m.out["edges"].append({"node": node, "next": p, "kind": kind, "site": site})

    def bind(self, name: str, v: Value) -> None:
        self.env[name] = v
        held = self.m.defs[self.fn].setdefault(name, [])
        held.extend(n for n in v.nodes if n not in held)

    # ---- blocks

    def new_block(self, parent: int) -> int:
        self.parent[self.blocks] = parent
        self.blocks += 1
        return self.blocks - 1

    def doms(self, block: int) -> list[int]:
        out = []
        while block >= 0:
            out.append(block)
            block = self.parent[block]
        return out

    def guarded(self, name: str, nodes: tuple[str, ...]) -> bool:
        here = set(self.doms(self.block))
        return any(name == n and held == frozenset(nodes) and b in here for held, n, b in self.safe)

    # ---- statements

    def walk(self, body: list[ast.stmt]) -> None:
        for s in body:
            if self.done:
                return
            self.instructions += 1
            getattr(self, "s_" + type(s).__name__, self.s_other)(s)

    def s_other(self, s: ast.stmt) -> None:
        for e in ast.iter_child_nodes(s):
            if isinstance(e, ast.expr):
                self.eval(e)

    def s_FunctionDef(self, s: ast.FunctionDef) -> None:
        guards = []
        for d in s.decorator_list:
            v = d.func if isinstance(d, ast.Call) else d
            guards.append(self.dotted(v).rsplit(".", 1)[-1])
            self.eval(d) if isinstance(d, ast.Call) else None
        base = "" if self.qual == "<module>" else self.qual + "."
        made = Function(self.m, base + s.name, s.args, s.body, self.fn, s.lineno, [g for g in guards if g])
        # the name stands for the function before its body is read, as that may call it
        self.bind(s.name, Value((self.node("function", made.fn, s.lineno),), path=s.name))
        made.run()

    s_AsyncFunctionDef = s_FunctionDef

    def s_ClassDef(self, s: ast.ClassDef) -> None:
        base = "" if self.qual == "<module>" else self.qual + "."
        for n in s.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                guards = [self.dotted(d.func if isinstance(d, ast.Call) else d).rsplit(".", 1)[-1] for d in n.decorator_list]
                Function(self.m, f"{base}{s.name}.{n.name}", n.args, n.body, self.fn, n.lineno, guards, cls=base + s.name).run()
            elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.Expr)):
                self.walk([n])

    def s_Return(self, s: ast.Return) -> None:
        if s.value is not None:
            self.link(self.ret, self.eval(s.value).nodes)
        self.done = True

    def s_Raise(self, s: ast.Raise) -> None:
        self.s_other(s)
        self.done = True

    def s_Break(self, s: ast.stmt) -> None:
        self.done = True

    s_Continue = s_Break

    def s_Assign(self, s: ast.Assign) -> None:
        v = self.eval(s.value)
        for t in s.targets:
            self.assign(t, v, s.lineno)

    def s_AnnAssign(self, s: ast.AnnAssign) -> None:
        if s.value is not None:
            self.assign(s.target, self.eval(s.value), s.lineno)

    def s_AugAssign(self, s: ast.AugAssign) -> None:
        old, new = self.eval(_loaded(s.target)), self.eval(s.value)
        n = self.node("def", "", s.lineno, (*old.nodes, *new.nodes))
        self.assign(s.target, Value((n,), objects=old.objects), s.lineno)

    def assign(self, t: ast.expr, v: Value, line: int) -> None:
        if isinstance(t, ast.Name):
            if v.nodes:
                n = self.node("def", t.id, line, v.nodes)
                v = Value((n,), v.const, v.path, v.objects, v.elements)
            self.bind(t.id, v)
        elif isinstance(t, (ast.Tuple, ast.List)):
            for i, e in enumerate(t.elts):
                part = v.elements[i] if v.elements is not None and i < len(v.elements) and not isinstance(e, ast.Starred) else Value(v.nodes)
                self.assign(e.value if isinstance(e, ast.Starred) else e, part, line)
        elif isinstance(t, (ast.Attribute, ast.Subscript)):
            base = self.eval(t.value)
            key = t.attr if isinstance(t, ast.Attribute) else self.key(t.slice)
            self.store(base, key, v.nodes)
            if isinstance(t, ast.Attribute):
                call = self.call_row(f"{base.path}.{t.attr}=", f"{base.path}.{t.attr}=", None, line)
                self.arg(call, 0, None, v)
        elif isinstance(t, ast.Starred):
            self.assign(t.value, v, line)

    def store(self, base: Value, key: str, nodes: tuple[str, ...]) -> None:
        for o in base.objects:
            self.objects[o].fields.setdefault(key, []).extend(nodes)
            self.link(self.objects[o].node, nodes)
        if not base.objects:
            for b in base.nodes:
                self.link(b, nodes)

    def key(self, s: ast.expr) -> str:
        c = self.eval(s).const
        return c if isinstance(c, str) else str(c) if isinstance(c, int) and not isinstance(c, bool) else "*"

    def s_If(self, s: ast.If) -> None:
        test = self.test(s.test)
        if isinstance(test.const, (bool, int, str)) or test.const is None:
            self.walk(s.body if test.const else s.orelse)
            return
        self.branches += 1
        self.fork([(s.body, True), (s.orelse, False)], s.test)

    def fork(self, arms: list[tuple[list[ast.stmt], bool]], cond: ast.expr | None) -> None:
        """Walk the arms from the same state and join what they leave."""
        start, env, objects = self.block, dict(self.env), {k: Object(o.node, {f: list(x) for f, x in o.fields.items()}, o.cls, o.open) for k, o in self.objects.items()}
        ends = []
        for body, truth in arms:
            self.env, self.done = dict(env), False
            self.block = self.new_block(start)
            first = self.block
            if cond is not None:
                self.learn(cond, truth, first, {})
            self.walk(body)
            ends.append((self.env, self.done, self.block, first))
        alive = [e for e in ends if not e[1]]
        self.done = not alive
        if cond is not None and len(alive) == 1 and len(ends) == 2:
            survivor = alive[0]
            for name in tested_names(cond):
                if name in env and env[name].nodes:
                    self.safe.append((frozenset(env[name].nodes), name, survivor[3]))
        for o in objects:
            if o not in self.objects:
                self.objects[o] = objects[o]
        self.block = self.new_block(alive[0][2] if len(alive) == 1 else start)
        self.env = merge([e[0] for e in alive] or [env])

    def learn(self, cond: ast.expr, truth: bool, block: int, seen: dict) -> None:
        """Names that are safe in this arm: compared with literals, or accepted by a guard call."""
        while isinstance(cond, ast.UnaryOp) and isinstance(cond.op, ast.Not):
            cond, truth = cond.operand, not truth
        if isinstance(cond, ast.BoolOp):
            if isinstance(cond.op, ast.And) == truth:
                for c in cond.values:
                    self.learn(c, truth, block, seen)
            return
        names: list[str] = []
        if isinstance(cond, ast.Compare) and len(cond.ops) == 1:
            left, op, right = cond.left, cond.ops[0], cond.comparators[0]
            literal = lambda e: isinstance(e, ast.Constant) and isinstance(e.value, (str, int)) or isinstance(e, (ast.Tuple, ast.List, ast.Set)) and e.elts and all(isinstance(x, ast.Constant) for x in e.elts)
            same = isinstance(op, (ast.Eq, ast.In))
            if isinstance(op, (ast.Eq, ast.NotEq, ast.In, ast.NotIn)) and same == truth:
                if isinstance(left, ast.Name) and literal(right):
                    names = [left.id]
                elif isinstance(right, ast.Name) and literal(left) and isinstance(op, (ast.Eq, ast.NotEq)):
                    names = [right.id]
        elif isinstance(cond, ast.Call) and truth and is_guard_name(self.dotted(cond.func).rsplit(".", 1)[-1]):
            names = [a.id for a in cond.args if isinstance(a, ast.Name)]
            if isinstance(cond.func, ast.Attribute) and isinstance(cond.func.value, ast.Name):
                names.append(cond.func.value.id)
        for name in names:
            v = self.env.get(name)
            if v is not None and v.nodes:
                self.safe.append((frozenset(v.nodes), name, block))

    def test(self, e: ast.expr) -> Value:
        before, self.in_test = self.in_test, True
        v = self.eval(e)
        self.in_test = before
        return v

    def s_While(self, s: ast.While) -> None:
        self.branches += 1
        self.loop(s.body, s.orelse, lambda: self.test(s.test))

    def s_For(self, s: ast.For) -> None:
        self.branches += 1

        def head() -> None:
            it = self.eval(s.iter)
            self.assign(s.target, Value(it.nodes), s.lineno)

        self.loop(s.body, s.orelse, head)

    s_AsyncFor = s_For

    def loop(self, body: list[ast.stmt], orelse: list[ast.stmt], head) -> None:  # noqa: ANN001
        header = self.block = self.new_block(self.block)
        before = dict(self.env)
        branches, instructions = self.branches, self.instructions
        for again in (1, 0):
            # calls of the first walk only serve the flow of the second
            self.again += again
            self.branches, self.instructions = branches, instructions
            head()
            self.block = self.new_block(header)
            self.done = False
            self.walk(body)
            self.done = False
            self.again -= again
            self.env = merge([before, self.env])
        self.block = self.new_block(header)
        self.walk(orelse)

    def s_With(self, s: ast.With) -> None:
        for i in s.items:
            v = self.eval(i.context_expr)
            if i.optional_vars is not None:
                self.assign(i.optional_vars, v, s.lineno)
        self.walk(s.body)

    s_AsyncWith = s_With

    def s_Try(self, s: ast.Try) -> None:
        self.walk(s.body)
        done, after = self.done, dict(self.env)
        exits = []
        for h in s.handlers:
            self.done = False
            start = self.block
            self.block = self.new_block(start)
            if h.name:
                self.bind(h.name, Value())
            self.walk(h.body)
            exits.append((dict(self.env), self.done))
            self.block = start
            self.env = dict(after)
        self.env = merge([e for e, d in [(after, done), *exits] if not d] or [after])
        self.done = done and all(d for _, d in exits)
        if not self.done:
            self.walk(s.orelse)
        held, self.done = self.done, False
        self.walk(s.finalbody)
        self.done = self.done or held

    s_TryStar = s_Try

    def s_Match(self, s: ast.Match) -> None:
        v = self.eval(s.subject)
        arms = []
        for c in s.cases:
            if isinstance(v.const, (str, int)) and isinstance(c.pattern, ast.MatchValue) and isinstance(c.pattern.value, ast.Constant):
                if c.pattern.value.value == v.const:
                    self.walk(c.body)
                    return
                continue
            for p in ast.walk(c.pattern):
                if isinstance(p, (ast.MatchAs, ast.MatchStar)) and p.name:
                    self.bind(p.name, Value(v.nodes))
            self.branches += 1
            arms.append((c.body, True))
        self.fork([*arms, ([], False)], None)

    def s_Global(self, s: ast.stmt) -> None:
        pass

    s_Nonlocal = s_Import = s_ImportFrom = s_Pass = s_Global

    # ---- expressions

    def eval(self, e: ast.expr) -> Value:
        return getattr(self, "e_" + type(e).__name__, self.e_other)(e)

    def e_other(self, e: ast.expr) -> Value:
        nodes: tuple[str, ...] = ()
        for c in ast.iter_child_nodes(e):
            if isinstance(c, ast.expr):
                nodes += self.eval(c).nodes
        return Value(nodes)

    def e_Constant(self, e: ast.Constant) -> Value:
        return Value(const=e.value)

    def e_Name(self, e: ast.Name) -> Value:
        v = self.env.get(e.id)
        if v is None:
            n = self.node("global", self.m.aliases.get(e.id, e.id), e.lineno)
            if self.enclosing:
                self.m.free.append((self.fn, e.id, n))
            return Value((n,), path=self.m.aliases.get(e.id, e.id))
        if v.nodes and self.guarded(e.id, v.nodes):
            return Value((self.node("guard", e.id, e.lineno),), path=v.path)
        return Value(v.nodes, v.const, v.path or e.id, v.objects, v.elements)

    def e_Attribute(self, e: ast.Attribute) -> Value:
        base = self.eval(e.value)
        path = f"{base.path}.{e.attr}" if base.path else e.attr
        return self.load(base, e.attr, path, e.lineno)

    def e_Subscript(self, e: ast.Subscript) -> Value:
        base = self.eval(e.value)
        key = self.key(e.slice)
        if base.elements is not None and key.lstrip("-").isdigit() and -len(base.elements) <= int(key) < len(base.elements):
            return base.elements[int(key)]
        if isinstance(base.const, (str, tuple)) and key.isdigit() and int(key) < len(base.const):
            return Value(const=base.const[int(key)])
        return self.load(base, key, f"{base.path}.{key}" if base.path and key != "*" else base.path, e.lineno)

    def load(self, base: Value, key: str, path: str, line: int) -> Value:
        if base.objects and key != "*":
            known = [self.objects[o] for o in base.objects]
            if not any(o.open for o in known):
                held = tuple(n for o in known for k in (key, "*") for n in o.fields.get(k, []))
                return Value((self.node("load", path, line, held),), path=path) if held else Value((), path=path)
        return Value((self.node("load", path, line, base.nodes),), path=path)

    def e_Call(self, e: ast.Call) -> Value:
        func = e.func
        receiver = Value()
        if isinstance(func, ast.Attribute):
            receiver = self.eval(func.value)
            classes = {self.objects[o].cls for o in receiver.objects if self.objects[o].cls}
            if isinstance(func.value, ast.Name) and func.value.id in _RECEIVERS and self.cls:
                classes = {self.cls}
            written = f"{receiver.path}.{func.attr}" if receiver.path else func.attr
            resolved = f"{min(classes)}.{func.attr}" if classes else written
        else:
            written = self.dotted(func)
            held = self.env.get(written, Value())
            resolved = self.m.aliases.get(written, written) if not held.nodes else written
            if not isinstance(func, ast.Name):
                receiver = self.eval(func)
        line = e.lineno
        given = [(i, None, a.value if isinstance(a, ast.Starred) else a) for i, a in enumerate(e.args)] + [(len(e.args) + i, k.arg, k.value) for i, k in enumerate(e.keywords)]
        values = [(i, name, self.eval(a)) for i, name, a in given]
        through = tuple(n for _, _, v in values for n in v.nodes) + receiver.nodes
        result = self.node("call", resolved, line)
        call = self.call_row(written, resolved, result, line)
        self.link(result, through, "through", call)
        for i, name, v in values:
            self.arg(call, i, name, v)
        if receiver.nodes:
            self.arg(call, -1, None, receiver)
        if isinstance(func, ast.Name) and held.nodes:
            self.arg(call, -2, None, held)  # what is called
        attr = func.attr if isinstance(func, ast.Attribute) else ""
        if attr in MUTATORS:
            into = tuple(n for _, _, v in values for n in v.nodes)
            self.store(receiver, "*", into) if into else None
        for _, _, v in values:
            for o in v.objects:
                self.objects[o].open = True  # a callee may fill it
        objects = frozenset()
        if attr == "" and written[:1].isupper() or (resolved.rsplit(".", 1)[-1][:1].isupper() and attr):
            name = f"o{len(self.objects)}"
            self.objects[name] = Object(result, cls=resolved, open=True)
            objects = frozenset({name})
        return Value((result,), path=f"{written}()" if written else "", objects=objects)

    def call_row(self, callee: str, resolved: str, result: str | None, line: int) -> str:
        call = f"{self.fn}@{self.calls}"
        self.calls += 1
        self.idx += 1
        self.instructions += 1
        self.m.out["calls"].append(
            {"call": call, "fn": self.fn, "callee": callee, "resolved": resolved, "result": result, "line": line, "block": self.block, "idx": self.idx, "doms": self.doms(self.block), "used_in_test": self.in_test, "again": self.again > 0}
        )
        return call

    def arg(self, call: str, slot: int, name: str | None, v: Value) -> None:
        literal = None if v.const is UNKNOWN else str(v.const)
        keys = sorted({k for o in v.objects for k in self.objects[o].fields if k != "*"}) or None
        for n in dict.fromkeys(v.nodes) or [None]:
            self.m.out["args"].append({"call": call, "slot": slot, "name": name, "node": n, "literal": literal, "keys": keys})

    def e_BinOp(self, e: ast.BinOp) -> Value:
        a, b = self.eval(e.left), self.eval(e.right)
        c = fold(e.op, a.const, b.const)
        if c is not UNKNOWN:
            return Value(const=c)
        nodes = (*a.nodes, *b.nodes)
        return Value((self.node("def", "", e.lineno, nodes),)) if nodes else Value()

    def e_UnaryOp(self, e: ast.UnaryOp) -> Value:
        v = self.eval(e.operand)
        if v.const is not UNKNOWN:
            try:
                return Value(const={ast.Not: lambda x: not x, ast.USub: lambda x: -x, ast.UAdd: lambda x: +x, ast.Invert: lambda x: ~x}[type(e.op)](v.const))
            except TypeError:
                return Value()
        return Value() if isinstance(e.op, ast.Not) else v

    def e_Compare(self, e: ast.Compare) -> Value:
        vs = [self.eval(x) for x in [e.left, *e.comparators]]
        if len(vs) == 2 and all(isinstance(v.const, (str, int, float, tuple)) for v in vs):
            try:
                return Value(const=_COMPARES[type(e.ops[0])](vs[0].const, vs[1].const))
            except (TypeError, KeyError):
                pass
        return Value()  # a truth value carries nothing of its operands

    def e_BoolOp(self, e: ast.BoolOp) -> Value:
        vs = [self.eval(v) for v in e.values]
        if all(isinstance(v.const, (bool, int, str)) for v in vs):
            out = vs[0].const
            for v in vs[1:]:
                out = (out and v.const) if isinstance(e.op, ast.And) else (out or v.const)
            return Value(const=out)
        return Value(tuple(n for v in vs for n in v.nodes))

    def e_IfExp(self, e: ast.IfExp) -> Value:
        t = self.test(e.test)
        if isinstance(t.const, (bool, int, str)):
            return self.eval(e.body if t.const else e.orelse)
        self.branches += 1
        a, b = self.eval(e.body), self.eval(e.orelse)
        return Value((*a.nodes, *b.nodes), objects=a.objects | b.objects)

    def e_JoinedStr(self, e: ast.JoinedStr) -> Value:
        vs = [self.eval(v.value if isinstance(v, ast.FormattedValue) else v) for v in e.values]
        if all(v.const is not UNKNOWN for v in vs):
            return Value(const="".join(str(v.const) for v in vs))
        nodes = tuple(n for v in vs for n in v.nodes)
        return Value((self.node("def", "", e.lineno, nodes),)) if nodes else Value()

    def e_List(self, e: ast.List) -> Value:
        vs = tuple(self.eval(x.value if isinstance(x, ast.Starred) else x) for x in e.elts)
        plain = not any(isinstance(x, ast.Starred) for x in e.elts)
        nodes = tuple(n for v in vs for n in v.nodes)
        if isinstance(e, ast.Tuple) and vs and all(v.const is not UNKNOWN for v in vs):
            return Value(const=tuple(v.const for v in vs), elements=vs)
        n = self.node("def", "", e.lineno, nodes)
        name = f"o{len(self.objects)}"
        self.objects[name] = Object(n, {str(i): list(v.nodes) for i, v in enumerate(vs)} if plain else {"*": list(nodes)}, open=not plain)
        return Value((n,), objects=frozenset({name}), elements=vs if plain and isinstance(e, ast.Tuple) else None)

    e_Tuple = e_Set = e_List

    def e_Dict(self, e: ast.Dict) -> Value:
        fields: dict[str, list[str]] = {}
        for k, v in zip(e.keys, e.values, strict=True):
            held = self.eval(v)
            fields.setdefault("*" if k is None else self.key(k), []).extend(held.nodes)
        n = self.node("def", "", e.lineno, tuple(x for f in fields.values() for x in f))
        name = f"o{len(self.objects)}"
        self.objects[name] = Object(n, fields)
        return Value((n,), objects=frozenset({name}))

    def e_ListComp(self, e: ast.ListComp) -> Value:
        held = dict(self.env)
        for g in e.generators:
            self.assign(g.target, Value(self.eval(g.iter).nodes), e.lineno)
            for c in g.ifs:
                self.test(c)
        parts = [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]
        nodes = tuple(n for p in parts for n in self.eval(p).nodes)
        self.env = held
        return Value((self.node("def", "", e.lineno, nodes),)) if nodes else Value()

    e_SetComp = e_GeneratorExp = e_DictComp = e_ListComp

    def e_Lambda(self, e: ast.Lambda) -> Value:
        held = dict(self.env)
        for a in e.args.args:
            self.env[a.arg] = Value()
        v = self.eval(e.body)
        self.env = held
        return Value(v.nodes)

    def e_NamedExpr(self, e: ast.NamedExpr) -> Value:
        v = self.eval(e.value)
        self.assign(e.target, v, e.lineno)
        return self.env.get(e.target.id, v)

    def dotted(self, e: ast.expr) -> str:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            base = self.dotted(e.value)
            base = self.m.aliases.get(base, base)
            return f"{base}.{e.attr}" if base else e.attr
        return ""


def _loaded(t: ast.expr) -> ast.expr:
    return ast.copy_location(ast.parse(ast.unparse(t), mode="eval").body, t) if not isinstance(t, ast.Name) else ast.copy_location(ast.Name(t.id, ast.Load()), t)


def tested_names(cond: ast.expr) -> list[str]:
    """Names whose bare truth, possibly negated, is what a condition tests, or that a guard call takes."""
    while isinstance(cond, ast.UnaryOp) and isinstance(cond.op, ast.Not):
        cond = cond.operand
    if isinstance(cond, ast.Name):
        return [cond.id]
    if isinstance(cond, ast.Call):
        name = cond.func.attr if isinstance(cond.func, ast.Attribute) else getattr(cond.func, "id", "")
        if is_guard_name(name):
            return [a.id for a in cond.args if isinstance(a, ast.Name)] + ([cond.func.value.id] if isinstance(cond.func, ast.Attribute) and isinstance(cond.func.value, ast.Name) else [])
    return []


#: Beginnings of names that accept or reject a value.
GUARD_PREFIXES = ("is_", "isalnum", "isdigit", "isalpha", "isidentifier", "isnumeric", "isdecimal", "valid", "allow", "check_", "verify", "fullmatch", "isvalid", "issafe", "isallowed")


def is_guard_name(name: str) -> bool:
    return name.lower().startswith(GUARD_PREFIXES)


def fold(op: ast.operator, a: object, b: object) -> object:
    """A constant result, bounded in size; UNKNOWN where there is none."""
    if a is UNKNOWN or b is UNKNOWN or isinstance(op, (ast.Pow, ast.LShift, ast.MatMult)):
        return UNKNOWN
    try:
        out = _OPS[type(op)](a, b)
    except (TypeError, ZeroDivisionError, KeyError, ValueError, OverflowError):
        return UNKNOWN
    return UNKNOWN if isinstance(out, (str, tuple, bytes)) and len(out) > 10_000 else out


_OPS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else UNKNOWN,
    ast.FloorDiv: lambda a, b: a // b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b, ast.BitAnd: lambda a, b: a & b,
    ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a ^ b, ast.RShift: lambda a, b: a >> b,
}
_COMPARES = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b,
}


def merge(envs: list[dict[str, Value]]) -> dict[str, Value]:
    """Join of environments: definitions unite, a constant survives if all agree."""
    if len(envs) == 1:
        return dict(envs[0])
    out: dict[str, Value] = {}
    for name in dict.fromkeys(n for e in envs for n in e):
        held = [e[name] for e in envs if name in e]
        first = held[0]
        same = all(v.const is not UNKNOWN and type(v.const) is type(first.const) and v.const == first.const for v in held) and len(held) == len(envs)
        out[name] = Value(
            tuple(dict.fromkeys(n for v in held for n in v.nodes)), first.const if same else UNKNOWN, first.path if all(v.path == first.path for v in held) else name,
            frozenset().union(*[v.objects for v in held]), first.elements if all(v.elements is first.elements for v in held) else None,
        )
    return out


def lower(path: str, source: str) -> dict:
    """The tables of one Python file."""
    m = Module(path, source)
    return {**m.out, "module": m.module, "partial": False}
