"""Languages with braces, by their tokens: assignments, calls and functions.

There is no grammar here, so what comes out is partial and says so: flows within
a function by assignments and call arguments, without branches' conditions,
fields or objects. A clean verdict on such a file is never reported as one.
Single-file components are blanked outside their scripts first, so that lines
stay where they are.
"""

from __future__ import annotations

import re

from .python_ast import MUTATORS, module_name

_TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|\d[\w.]*|::|=>|->|:=|[=!<>]=+|\+=|\n|\S", re.S)
_FUNCTION = {"function", "func", "fn", "def"}
_SKIP = frozenset("if else for while switch case return try catch finally match await async const let var mut new throw defer go struct class import from unsafe break continue in of export default pub use type interface static".split())
_BRANCH = frozenset("if for while case catch match".split())
_SCRIPT = re.compile(r"(<script[^>]*>)(.*?)(</script>)", re.S | re.I)
_IMPORT = re.compile(r"import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)|import\s+(?:(\w+)\s+)?\"([^\"]+)\"|use\s+([\w:]+)::(\w+)\s*;")
_NAMED = re.compile(r"import\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]")


def blank_outside_scripts(source: str) -> str:
    """The text of scripts only; everything else is blanked, line ends stay."""
    keep = [(m.start(2), m.end(2)) for m in _SCRIPT.finditer(source)]
    out, at = [], 0
    for a, b in keep:
        out.append(re.sub(r"[^\n]", " ", source[at:a]))
        out.append(source[a:b])
        at = b
    out.append(re.sub(r"[^\n]", " ", source[at:]))
    return "".join(out)


#: Attributes of markup in code whose value is a sink (fixed values).
ATTRIBUTES = ("dangerouslySetInnerHTML", "href", "src", "srcDoc", "innerHTML")
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", re.M)


def lower(path: str, source: str, roles: dict[str, str] | None = None) -> dict:
    """The tables of one file, partial.

    ``roles`` teaches keywords that the language uses as 'function' or 'branch'.
    Of preprocessor conditions all arms are lowered; the directives are blanked.
    """
    if path.endswith(".vue"):
        source = blank_outside_scripts(source)
    return {**_Lexer(path, source, roles or {}).run(), "module": module_name(path), "partial": True}


class _Scope:
    def __init__(self, fn: str, qual: str, line: int, depth: int, enclosing: str | None) -> None:
        self.fn, self.qual, self.line, self.depth, self.enclosing = fn, qual, line, depth, enclosing
        self.env: dict[str, tuple[str, ...]] = {}
        self.params: list[str] = []
        self.branches = self.instructions = self.n = self.calls = 0
        self.ret = ""


class _Lexer:
    def __init__(self, path: str, source: str, roles: dict[str, str]) -> None:
        self.path = path
        self.is_c = path.endswith((".c", ".h"))
        self.functions = _FUNCTION | {k for k, r in roles.items() if r == "function"}
        self.branches = _BRANCH | {k for k, r in roles.items() if r == "branch"}
        self.out: dict[str, list] = {k: [] for k in ("functions", "nodes", "edges", "calls", "args", "imports")}
        self.aliases: dict[str, str] = {}
        if self.is_c:
            for m in _INCLUDE.finditer(source):
                self.out["imports"].append({"local": m[1], "package": m[1], "symbol": None})
            source = _DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
        for m in _IMPORT.finditer(source):
            local, package = next(((a, b) for a, b in ((m[1], m[2]), (m[3], m[4]), (m[5], m[6]), (m[8], m[7])) if b), (None, None))
            local = local or package.rsplit("/", 1)[-1]
            self._import(local, package.removeprefix("node:"), None)
        for m in _NAMED.finditer(source):
            for part in m[1].split(","):
                names = part.split(" as ")
                if names[0].strip():
                    self._import(names[-1].strip(), m[2].removeprefix("node:"), names[0].strip())
        self.toks: list[tuple[str, int]] = []
        line = 1
        for m in _TOKEN.finditer(source):
            t = m[0]
            if t == "\n":
                if self.toks and self.toks[-1][0] not in ("\n", ";", "{", "}", ",", "("):
                    self.toks.append(("\n", line))
            elif not t.startswith(("//", "/*")):
                self.toks.append((t, line))
            line += t.count("\n")
        self.scopes = [self._scope("<module>", 1, -1, None)]
        self.i = 0
        # blocks by braces: what stands in an outer block comes before what stands in an inner one
        self.blocks, self.open = 1, [0]

    def _import(self, local: str, package: str, symbol: str | None) -> None:
        self.aliases[local] = f"{package}.{symbol}" if symbol else package
        self.out["imports"].append({"local": local, "package": package, "symbol": symbol})

    def _scope(self, qual: str, line: int, depth: int, enclosing: str | None) -> _Scope:
        fn = f"{self.path}::{qual}"
        if any(f["fn"] == fn for f in self.out["functions"]):
            qual, fn = f"{qual}@{line}", f"{fn}@{line}"
        s = _Scope(fn, qual, line, depth, enclosing)
        row = {"fn": fn, "qual": qual, "line": line, "params": s.params, "ret": "", "enclosing": enclosing, "guards": [], "branches": 0, "instructions": 0}
        self.out["functions"].append(row)
        s.row = row
        s.ret = row["ret"] = self._node(s, "return", "", line)
        return s

    def _node(self, s: _Scope, kind: str, path: str, line: int, preds: tuple[str, ...] = (), edge: str = "flow", site: str | None = None) -> str:
        name = f"{s.fn}#{s.n}"
        s.n += 1
        self.out["nodes"].append({"node": name, "fn": s.fn, "kind": kind, "path": path, "line": line, "block": 0})
        for p in dict.fromkeys(preds):
            self.out["edges"].append({"node": name, "next": p, "kind": edge, "site": site})
        return name

    def run(self) -> dict:
        depth = 0
        toks = self.toks
        while self.i < len(toks):
            t, line = toks[self.i]
            s = self.scopes[-1]
            if t == "{" and self._attribute(s):
                pass
            elif t == "{":
                depth += 1
                self.i += 1
                self.open.append(self.blocks)
                self.blocks += 1
            elif t == "}":
                depth -= 1
                self.i += 1
                if len(self.open) > 1:
                    self.open.pop()
                while len(self.scopes) > 1 and depth <= self.scopes[-1].depth:
                    self.scopes.pop()
            elif t in self.functions and self._function(depth) or self.is_c and depth == 0 and self._c_function(depth):
                pass
            elif t in ("\n", ";"):
                self.i += 1
            else:
                s.row["branches"] += t in self.branches
                self._statement(s)
        return self.out

    def _attribute(self, s: _Scope) -> bool:
        """An attribute of markup whose braces hold its value: a store into a property."""
        toks, i = self.toks, self.i
        if i < 2 or toks[i - 1][0] != "=" or toks[i - 2][0] not in ATTRIBUTES:
            return False
        end, level = i, 0
        while end < len(toks):
            level += (toks[end][0] == "{") - (toks[end][0] == "}")
            if level == 0:
                break
            end += 1
        call = self._call(s, f"markup.{toks[i - 2][0]}=", None, toks[i][1])
        self._args(call, [(0, self._expr(s, [t for t in toks[i + 1 : end] if t[0] not in "{}"]), None)])
        self.i = end + 1
        return True

    def _function(self, depth: int) -> bool:
        """A function's head up to its opening brace."""
        toks, j = self.toks, self.i + 1
        name = ""
        if j < len(toks) and toks[j][0] == "(" and toks[self.i][0] == "func":  # a receiver in brackets
            j = self._close(j) + 1
        if j < len(toks) and re.fullmatch(r"[A-Za-z_$][\w$]*", toks[j][0]):
            name = toks[j][0]
            j += 1
        while j < len(toks) and toks[j][0] not in ("(", "{", ";"):
            j += 1
        if j >= len(toks) or toks[j][0] != "(":
            return False
        line = toks[self.i][1]
        return self._body(self._scope(name or f"<fn@{line}>", line, depth, self.scopes[-1].fn), j, last=False)

    def _c_function(self, depth: int) -> bool:
        """A head without keyword: types, a name, brackets, and a brace right behind."""
        toks, j = self.toks, self.i
        while j < len(toks) and toks[j][0] not in ("(", ";", "=", "{", "}"):
            j += 1
        if j >= len(toks) or toks[j][0] != "(" or j < self.i + 2 or not re.fullmatch(r"[A-Za-z_]\w*", toks[j - 1][0]):
            return False
        after = next((t for t, _ in toks[self._close(j) + 1 : self._close(j) + 3] if t != "\n"), "")
        return after == "{" and self._body(self._scope(toks[j - 1][0], toks[j - 1][1], depth, self.scopes[-1].fn), j, last=True)

    def _body(self, s: _Scope, j: int, last: bool) -> bool:
        """Bind the parameters in the brackets at ``j`` (each group's first or last name) and go to the brace."""
        toks, end = self.toks, self._close(j)
        groups: list[list[tuple[str, int]]] = [[]]
        level = 0
        for t, ln in toks[j + 1 : end]:
            level += (t in "([{<") - (t in ")]}>")
            if t == "," and level == 0:
                groups.append([])
            elif re.fullmatch(r"[A-Za-z_$][\w$]*", t) and t not in ("mut", "const", "self", "struct", "unsigned", "void"):
                groups[-1].append((t, ln))
        for g in groups:
            if g:
                t, ln = g[-1] if last else g[0]
                p = self._node(s, "param", t, ln)
                s.params.append(p)
                s.env[t] = (p,)
        self.i = end + 1
        while self.i < len(toks) and toks[self.i][0] not in ("{", ";"):
            self.i += 1
        if self.i < len(toks) and toks[self.i][0] == "{":
            self.scopes.append(s)
        return True

    def _close(self, j: int) -> int:
        level = 0
        while j < len(self.toks):
            level += (self.toks[j][0] == "(") - (self.toks[j][0] == ")")
            if level == 0:
                return j
            j += 1
        return len(self.toks) - 1

    def _statement(self, s: _Scope) -> None:
        """One statement: an optional target, then an expression."""
        start, level = self.i, 0
        toks = self.toks
        while self.i < len(toks):
            t = toks[self.i][0]
            if level == 0 and (t in ("\n", ";", "}") or t == "{" and self.i > start):
                break
            if t in self.functions and self.i > start:
                break
            level += (t in "([") - (t in ")]")
            self.i += 1
        if self.i == start:
            self.i += 1
        part = toks[start : self.i]
        s.row["instructions"] += 1
        equal = next((k for k, (t, _) in enumerate(part) if t in ("=", ":=", "+=")), None)
        if equal is not None and equal > 0:
            target = [t for t, _ in part[:equal]]
            nodes = self._expr(s, part[equal + 1 :])
            line = part[0][1]
            names = [t for t in target if re.fullmatch(r"[A-Za-z_$][\w$]*", t) and t not in _SKIP]
            if "." in target and names:
                call = self._call(s, ".".join(names) + "=", None, line)
                self._args(call, [(0, nodes, None)])
                for n in s.env.get(names[0], ()):
                    self.out["edges"] += [{"node": n, "next": p, "kind": "flow", "site": None} for p in nodes if p != n]
            elif names:
                old = s.env.get(names[0], ()) if part[equal][0] == "+=" else ()
                for name in names[:1] if ":" in target else names:
                    n = self._node(s, "def", name, line, (*nodes, *old))
                    s.env[name] = (n,)
        else:
            nodes = self._expr(s, part)
            if part and part[0][0] == "return":
                self.out["edges"] += [{"node": s.ret, "next": p, "kind": "flow", "site": None} for p in dict.fromkeys(nodes)]

    def _expr(self, s: _Scope, part: list[tuple[str, int]]) -> tuple[str, ...]:
        nodes: list[str] = []
        k = 0
        while k < len(part):
            t, line = part[k]
            if t[0] == "`":
                for inner in re.findall(r"\$\{([^}]*)\}", t):
                    nodes += self._expr(s, [(x, line) for x in re.findall(r"[A-Za-z_$][\w$]*|\S", inner)])
            elif re.match(r"[A-Za-z_$]", t) and t not in _SKIP:
                chain = [t]
                k += 1
                while k + 1 < len(part) and part[k][0] in (".", "::", "->") and re.match(r"[A-Za-z_$]", part[k + 1][0]):
                    chain.append(part[k + 1][0])
                    k += 2
                root = s.env.get(chain[0])
                if k < len(part) and part[k][0] in ("(", "!"):
                    k += part[k][0] == "!"
                    end, level = k, 0
                    while end < len(part):
                        level += (part[end][0] in "([{") - (part[end][0] in ")]}")
                        if level == 0:
                            break
                        end += 1
                    nodes.append(self._call_expr(s, chain, root, part[k + 1 : end], line))
                    k = end + 1
                    continue
                path = ".".join([self.aliases.get(chain[0], chain[0]), *chain[1:]])
                if root is not None and len(chain) == 1:
                    nodes += root
                else:
                    nodes.append(self._node(s, "load" if root is not None else "global", path, line, root or ()))
                continue
            k += 1
        return tuple(dict.fromkeys(nodes))

    def _call_expr(self, s: _Scope, chain: list[str], root: tuple[str, ...] | None, inner: list[tuple[str, int]], line: int) -> str:
        path = ".".join([self.aliases.get(chain[0], chain[0]), *chain[1:]])
        groups: list[list[tuple[str, int]]] = [[]]
        level = 0
        for t in inner:
            level += (t[0] in "([{") - (t[0] in ")]}")
            if t[0] == "," and level == 0:
                groups.append([])
            else:
                groups[-1].append(t)
        given = []
        for slot, g in enumerate(groups):
            if g:
                literal = g[0][0].strip("\"'`") if len(g) == 1 and re.match(r"[\"'\d]", g[0][0]) else None
                given.append((slot, self._expr(s, g), literal))
        receiver = root if len(chain) > 1 and root is not None else ()
        call = self._call(s, path, None, line)
        result = self._node(s, "call", path, line, (*[n for _, ns, _ in given for n in ns], *receiver), "through", call)
        self.out["calls"][-1]["result"] = result
        self._args(call, given)
        for n in receiver:
            self.out["args"].append({"call": call, "slot": -1, "name": None, "node": n, "literal": None, "keys": None})
        if chain[-1] in MUTATORS:
            for n in receiver:
                self.out["edges"] += [{"node": n, "next": p, "kind": "flow", "site": None} for _, ns, _ in given for p in ns if p != n]
        return result

    def _call(self, s: _Scope, path: str, result: str | None, line: int) -> str:
        call = f"{s.fn}@{s.calls}"
        s.calls += 1
        self.out["calls"].append({"call": call, "fn": s.fn, "callee": path, "resolved": path, "result": result, "line": line, "block": self.open[-1], "idx": s.calls, "doms": self.open[::-1], "used_in_test": False, "again": False})
        return call

    def _args(self, call: str, given: list[tuple[int, tuple[str, ...], str | None]]) -> None:
        for slot, nodes, literal in given:
            for n in nodes or (None,):
                self.out["args"].append({"call": call, "slot": slot, "name": None, "node": n, "literal": literal, "keys": None})
