"""The script parser: syntax that it must read, and what it makes of it."""

from __future__ import annotations

import ast

import pytest

from weirflow.frontends import script


def parsed(path, source):
    p = script.Parser(path, source)
    return ast.unparse(ast.Module(p.program(), [])), p.partial


READ = [
    ("a.ts", "const a: Array<string> = [], b = x as unknown as C[];"), ("a.ts", "function f<T extends object>(x: T, y?: number): Promise<Map<string, T[]>> { return g<T>(x); }"),
    ("a.ts", "interface A { x: string; y(): void }\ntype B = { a: 1 } | C<D>;\nlet z = 1"), ("a.ts", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nabstract class Q { abstract m(): void }"),
    ("a.ts", "class A<T> extends B<T> implements C { private readonly x: number = 3; static #p?: string; constructor(private y: string) { super(); } get v(): string { return this.y } @Dec() m(@Inject() a: A): void {} [key: string]: any; }"),
    ("a.js", "const r = s.match(/a\\/[/]b/g)[0] / 2; x = a >> 2 >>> 1;"), ("a.js", "for (const [k, v] of Object.entries(o)) { if (k in v) continue; }\nfor (let i = 0, n = 3; i < n; i++) g(i);\nfor (const k in o) h(k)"),
    ("a.js", "outer: while (true) { break outer }\ndo { f() } while (x)\ng()"), ("a.js", "!function () { f() }();\n(async () => { await g() })()"), ("a.js", "const { data: { user = 1 }, ...rest } = await f(), [p, , q] = h();"),
    ("a.js", "const o = { a, 'b-c': 1, [d]: 2, e() { return 1 }, get f() { return 2 }, async g() {}, ...h, i: x => x, 3: 4 };"), ("a.js", "var async = 3, of = 1, type = 2; async = of; type = 4; get(1)"),
    ("a.js", "const t = `a${f(`b${c}`)}d${ {x: 1}.x }`; tag`x${y}`; a?.b?.[c]?.(d) ?? e"), ("a.tsx", "const A = () => <div className=\"x\" onClick={() => f(a)} {...p}>it's {b} <B.C d={e} /> t & u<></></div>;\nfoo()"),
    ("a.ts", "let a1 = b1 ? (c1) : (d1) => e1; let g = (a: number): number | undefined => a > 1 ? a : undefined"), ("a.ts", "export = foo; import fs = require('fs'); export * from 'n'; import type { Q } from 'q'"),
]


@pytest.mark.parametrize(("path", "source"), READ)
def test_is_read_whole(path, source):
    out, partial = parsed(path, source)
    assert not partial and out
    assert not script.lower(path, source)["partial"]


@pytest.mark.parametrize(("source", "want"), [
    ("const f = (a, { b }) => a + b;", "def f(a, <p1>):\n    b = <p1>.b\n    return a + b"), ("x = y = z", "y = z\nx = y\nx"), ("a += b", "a = a + b\na"), ("const cp = require('node:child_process')", "import child_process as cp"),
    ("import { a as b } from './m'; export { b as c }", "from d.m import a as b\nfrom d.f import b as c"), ("switch (a) { case 1: f(); case 2: g(); break; default: h() }", "match a:\n    case 1:\n        f()\n        g()\n        pass\n    case 2:\n        g()\n        pass\n    case _:\n        h()"),
    ("el['innerHTML'] = q", "el.innerHTML = q\nel.innerHTML"), ("class A { constructor(x) { this.x = x } }", "class A:\n\n    def __init__(x):\n        self.x = x\n        self.x"),
])
def test_becomes(source, want):
    assert parsed("d/f.js", source) == (want, False)


def test_what_cannot_be_read_is_skipped_and_said():
    out, partial = parsed("a.js", "let a = ;\nf(1)\nfunction g( { \n")
    assert partial and "f(1)" in out
    for source in ("", "\n", "`", "/*", "'", "{", "}", ")", "<", "a => {", "\x00", "x" * 100_000, "(" * 3000):
        assert isinstance(script.lower("a.tsx", source)["partial"], bool)


def test_lines_stay():
    calls = script.lower("a.vue", "<template>\n  <p/>\n</template>\n<script>\nf(\n  `a\n${g(1)}`,\n)\nh(2)\n</script>\n")["calls"]
    assert {c["callee"]: c["line"] for c in calls} == {"f": 5, "g": 7, "h": 9}
