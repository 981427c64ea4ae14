from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weirflow.frontends import lexical, python_ast
from weirflow.operators import checks, intra, mining, report, taint
from weirflow.scan import Scan, ScanOptions, identity

HEAD = "import os, shlex\nfrom flask import request\n"

#: name, body of a file after HEAD, verdict of its only command sink
PROBES = [
    ("straight", "def v():\n    q = request.args['q']\n    os.system(q)\n", "vulnerable"),
    ("concat", "def v():\n    os.system('ls ' + request.args.get('q'))\n", "vulnerable"),
    ("fstring", "def v():\n    q = request.form['q']\n    os.system(f'ls {q}')\n", "vulnerable"),
    ("sanitized", "def v():\n    os.system(shlex.quote(request.args['q']))\n", "sanitized"),
    ("branch", "def v(a):\n    q = 'x'\n    if a:\n        q = request.args['q']\n    os.system(q)\n", "vulnerable"),
    ("early_return", "def v():\n    q = request.args['q']\n    if q not in ('a', 'b'):\n        return 0\n    os.system(q)\n", "clean"),
    ("guard_call", "def v():\n    q = request.args['q']\n    if not is_safe(q):\n        return 0\n    os.system(q)\n", "clean"),
    ("guard_one_arm", "def v():\n    q = request.args['q']\n    if q == 'a':\n        print(q)\n    os.system(q)\n", "vulnerable"),
    ("dead_branch", "def v():\n    q = 'x'\n    if False:\n        q = request.args['q']\n    os.system(q)\n", "clean"),
    ("dict_hit", "def v():\n    d = {'a': request.args['q'], 'b': 'x'}\n    os.system(d['a'])\n", "vulnerable"),
    ("dict_miss", "def v():\n    d = {'a': request.args['q'], 'b': 'x'}\n    os.system(d['b'])\n", "clean"),
    ("list_position", "def v():\n    p = ['x', request.args['q']]\n    os.system(p[0])\n", "clean"),
    ("list_append", "def v():\n    p = []\n    p.append(request.args['q'])\n    os.system(' '.join(p))\n", "vulnerable"),
    ("helper_return", "def h(x):\n    return 'ls ' + x\ndef v():\n    os.system(h(request.args['q']))\n", "vulnerable"),
    ("helper_drops", "def h(x):\n    return 'ls'\ndef v():\n    os.system(h(request.args['q']))\n", "clean"),
    ("keyword", "def h(a, b='x'):\n    return b\ndef v():\n    os.system(h('1', b=request.args['q']))\n", "vulnerable"),
    ("other_keyword", "def h(a, b='x'):\n    return b\ndef v():\n    os.system(h(a=request.args['q']))\n", "unknown"),  # blind spot: defaults feed nothing
    ("other_call_site", "def h(x):\n    return x\ndef v():\n    h(request.args['q'])\n    os.system(h('ls'))\n", "clean"),
    ("recursion", "def h(x, n):\n    if n:\n        return h(x, n - 1)\n    return x\ndef v():\n    os.system(h(request.args['q'], 3))\n", "vulnerable"),
    ("closure", "def v():\n    q = request.args['q']\n    def run():\n        os.system(q)\n    run()\n", "vulnerable"),
    ("module_scope", "import sys\nq = sys.argv[1]\nos.system(q)\n", "vulnerable"),
    ("method", "class C:\n    def go(self, x):\n        os.system(x)\ndef v():\n    C().go(request.args['q'])\n", "vulnerable"),
    ("comparison_cut", "def v():\n    os.system(request.args['q'] == 'x')\n", "clean"),
    ("open_parameter", "def v(q):\n    os.system(q)\n", "unknown"),
    ("loop_carried", "def v():\n    q = ''\n    for i in range(2):\n        os.system(q)\n        q = request.args['q']\n", "vulnerable"),
    ("alias_import", "from os import system as s\ndef v():\n    s(request.args['q'])\n", "vulnerable"),
    ("reassigned", "def v():\n    q = request.args['q']\n    q = 'ls'\n    os.system(q)\n", "clean"),
    ("try_except", "def v():\n    try:\n        q = request.args['q']\n    except Exception:\n        q = ''\n    os.system(q)\n", "vulnerable"),
]


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(f"p/{name}.py", HEAD + body) for name, body, _ in PROBES] + [
        ("lib/impl.py", "def build(x):\n    return 'ls ' + x\n"), ("lib/__init__.py", "from lib.impl import build\n"), ("use.py", HEAD + "from lib import build\ndef v():\n    os.popen(build(request.args['q']))\n"),
        ("bad.py", "def (:"), ("none.py", None), ("web/a.js", "const cp = require('child_process');\nfunction go(req) {\n  const c = `ls ${req.query.q}`;\n  cp.exec(c);\n}\n"), ("x.rb", "puts 1"),
    ]
    return Scan(spark.createDataFrame(rows, "path string, source string"))


def test_probes(scan):
    got = {r.file: r.verdict for r in scan.findings.where("sink = 'os.system'").select("file", "verdict").collect()}
    assert {n: got.get(f"p/{n}.py") for n, _, _ in PROBES} == {n: v for n, _, v in PROBES}


def test_across_files_and_languages(scan, rows):
    assert rows(scan.findings.where("file in ('use.py', 'web/a.js')"), "file", "line", "verdict") == [("use.py", 5, "vulnerable"), ("web/a.js", 4, "vulnerable")]
    steps = scan.findings.where("file = 'use.py'").first().steps
    assert steps[0].detail == "flask.request.args.q" and [s.func for s in steps if s.func.startswith("lib/")] == ["lib/impl.py::build"] * 3


def test_failures_stay_in_their_file(scan, rows):
    assert rows(scan.program.status.where("error is not null"), "file") == [("bad.py",), ("none.py",)]
    c = scan.coverage.first()
    assert c.status == "partial" and not c.clean and c.n_failed == 2 and c.n_partial == 0
    assert scan.silent.where("cut_reasons = 'guard'").count() == 2


def test_order_and_partitioning_change_nothing(spark, scan, rows):
    again = Scan(scan.files.select("path", "source").orderBy(F.desc("path")).repartition(7))
    columns = ("file", "line", "slot", "verdict", "source")
    assert rows(again.findings, *columns) == rows(scan.findings, *columns)


def test_reports(scan, rows, tmp_path):
    a = scan.advisories
    n = a.count()
    assert n == a.select("fingerprint", "line").distinct().count() > 10
    assert scan.with_options(ScanOptions(min_level="critical", min_confidence=0.95)).gated.where("gate = 'below-confidence'").count() == n
    assert report.annotations(a).where("value like '::error file=use.py,line=5,title=taint.command-injection::%'").count() == 1
    log = report.sarif_runs(a.where("file = 'use.py'")).first().value
    assert '"version":"2.1.0"' in log and '"ruleId":"taint.command-injection"' in log and '"startLine":5' in log
    report.save_baseline(a.where("file <> 'use.py'"), str(tmp_path / "b"))
    assert rows(report.since_baseline(a, str(tmp_path / "b")), "file") == [("use.py",)]
    frames = report.code_frames(a.where("file = 'use.py'"), scan.files)
    assert [r.n for r in frames.orderBy("n").collect()] == [4, 5, 6]
    assert report.json_lines(a).count() == n and report.diagnostics(a).count() == n
    patch = scan.files.sparkSession.createDataFrame([("p", i, x) for i, x in enumerate(["+++ b/use.py", "@@ -4,0 +5 @@", "+x"])], "diff string, n int, line string")
    assert rows(scan.in_diff(patch), "file_path") == [("use.py",)]
    assert identity(scan.files.sparkSession).count() == 1 and taint.explain(scan.findings).count() > 0


def test_checks(spark, rows):
    src = "import hashlib, requests\ndef a(password, u):\n    hashlib.md5(password)\n    hashlib.md5(u, usedforsecurity=False)\n    requests.get(u, verify=False)\n    if u.url.startswith('http'):\n        return 1\ndef b(r):\n    r.set_cookie('k', secure=True)\n@login_required\ndef c():\n    delete_all()\ndef d():\n    check()\n    delete_all()\ndef e(x):\n    if x:\n        check()\n    delete_all()\n"
    p = Scan(spark.createDataFrame([("m.py", src)], "path string, source string")).program
    assert rows(checks.run(p), "rule", "line") == [("cookie_httponly_missing", 9), ("credential_kdf_policy", 3), ("policy_banned_insecure_transport", 5), ("substring_allowlist_guard", 6), ("weak_hash", 3)]
    assert rows(checks.guard_before(p, "delete_all", ("check", "login_required"), "r"), "fn") == [("m.py::e",)]
    assert rows(checks.complexity(p, 1), "fn") == [("m.py::a",), ("m.py::e",)]


def test_control_flow(spark, rows):
    cfg = [("d", 0, 1), ("d", 0, 2), ("d", 1, 3), ("d", 2, 3), ("l", 0, 1), ("l", 1, 2), ("l", 2, 1), ("l", 1, 3)]
    c = spark.createDataFrame(cfg, "fn string, src int, dst int")
    b = spark.createDataFrame([("d", i) for i in (0, 1, 2, 3, 9)], "fn string, block long")
    dom = {}
    for fn, block, d in rows(intra.dominators(b, c)):
        dom.setdefault((fn, block), set()).add(d)
    assert dom["d", 3] == {0, 3} and dom["d", 1] == {0, 1} and dom["d", 9] == {0, 1, 2, 3, 9} and dom["l", 2] == {0, 1, 2}
    phis = intra.phi_places(spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("l", 2, "i"), ("l", 0, "i")], "fn string, block long, var string"), c)
    assert rows(phis) == [("d", "x", 3), ("l", "i", 1)]


def test_values(spark, rows):
    ins = spark.createDataFrame([("f", 0, 0, "i", "const", "0", None), ("f", 2, 0, "i", "+", "i", "1"), ("g", 0, 0, "x", "const", "5", None), ("g", 1, 0, "x", "const", "9", None), ("g", 2, 0, "y", "*", "x", "x")], "fn string, block int, idx int, dest string, op string, a string, b string")
    br = spark.createDataFrame([("f", 1, "i", "<", 10, 2, 3)], "fn string, block int, var string, op string, k int, on_true int, on_false int")
    cfg = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 1, 3), ("g", 0, 1), ("g", 0, 2), ("g", 1, 2)], "fn string, src int, dst int")
    got = {(r.fn, r.block, r["var"]): (r.low, r.high, r.converged) for r in intra.value_intervals(ins, br, cfg).collect()}
    assert got["f", 3, "i"] == (0, 10, True) and got["f", 2, "i"] == (1, 10, True) and got["g", 2, "x"] == (5, 9, True) and got["g", 2, "y"] == (25, 81, True)
    acc = spark.createDataFrame([("f", 2, "buf", "i"), ("f", 2, "big", "i"), ("f", 2, "buf", "zz")], "fn string, block long, buffer string, index string")
    cap = spark.createDataFrame([("f", "buf", 10), ("f", "big", 11)], "fn string, buffer string, capacity long")
    assert rows(intra.out_of_bounds(acc, intra.value_intervals(ins, br, cfg), cap), "buffer", "rule") == [("buf", "out_of_bounds_access")]


def test_heap_and_lifetimes(spark, rows):
    cons = spark.createDataFrame([("f", "alloc", "a", "A", None), ("f", "alloc", "b", "B", None), ("f", "copy", "c", "a", None), ("f", "store", "c", "b", "x"), ("f", "load", "d", "a", "x"), ("f", "load", "e", "a", "y"), ("f", "load", "g", "a", "*")], "fn string, op string, dest string, src string, field string")
    assert rows(intra.points_to(cons)) == [("f", "a", "A"), ("f", "b", "B"), ("f", "c", "A"), ("f", "d", "B"), ("f", "g", "B")]
    ev = [("u", 0, 0, "alloc", "m"), ("u", 0, 1, "free", "m"), ("u", 0, 2, "use", "m"), ("u", 0, 3, "free", "m"), ("k", 0, 0, "alloc", "m"), ("k", 1, 0, "free", "m"), ("k", 2, 0, "exit", None), ("n", 0, 0, "free", "m"), ("o", 0, 0, "alloc", "m"), ("o", 1, 0, "free", "m"), ("o", 2, 0, "use", "m")]
    cfg = [("k", 0, 1), ("k", 0, 2), ("k", 1, 2), ("o", 0, 1), ("o", 0, 2), ("o", 1, 2)]
    got = intra.lifetimes(spark.createDataFrame(ev, "fn string, block int, idx int, op string, loc string"), spark.createDataFrame(cfg, "fn string, src int, dst int"))
    assert rows(got, "fn", "rule", "block", "idx") == [("k", "memory_leak", 2, 0), ("n", "uninitialized_free", 0, 0), ("u", "double_free", 0, 3), ("u", "use_after_free", 0, 2)]


def test_frontends_alone():
    out = python_ast.lower("a/b.py", "def f(x):\n    return x\nclass C:\n    def f(self):\n        pass\ndef f(y):\n    return y\n")
    assert [f["qual"] for f in out["functions"]] == ["f", "C.f", "f@6", "<module>"] and out["module"] == "a.b"
    vue = "<template>\n<b>x()</b>\n</template>\n<script>\nfoo(1)\n</script>"
    assert lexical.blank_outside_scripts(vue).count("\n") == vue.count("\n")
    assert [(c["callee"], c["line"]) for c in lexical.lower("a.vue", vue)["calls"]] == [("foo", 5)]
    go = lexical.lower("a.go", 'package a\nfunc (s *S) Run(q string) error {\n\tc := "x" + q\n\treturn exec.Command(c, "y")\n}\n')
    assert [f["qual"] for f in go["functions"]] == ["<module>", "Run"] and go["calls"][0]["callee"] == "exec.Command" and go["partial"]


def test_direct_references_and_bounds(spark, rows):
    src = (
        HEAD + "from pydantic import Field\ndef a(db):\n    return db.find_one({'user_id': request.args['u']})\ndef b(db):\n    check_owner()\n    return db.find_one({'user_id': request.args['u']})\n"
        "@login_required\ndef c(q):\n    return q.filter_by(id=request.args['i'])\ndef d(q):\n    return q.filter_by(color=request.args['i'])\ndef e(q):\n    return q.filter_by(id=request.args['i'])\n"
        "n = Field(description='at most 10 items')\nm = Field(description='at most 10 items', le=10)\nk = Field(description='a name')\n"
    )
    p = Scan(spark.createDataFrame([("m.py", src), ("z.py", "x = Field(description='max 3')\n")], "path string, source string")).program
    assert rows(taint.direct_references(p), "fn") == [("m.py::a",), ("m.py::e",)]
    assert rows(checks.schema_bounds(p), "file", "line") == [("m.py", 16), ("z.py", 1)]
    assert rows(checks.importing(p, "pydantic")) == [("m.py",)]
    assert checks.named_argument(p, "Field", "le", "r", required=("10",), package="pydantic").where("file = 'z.py'").count() == 0


def test_learning_from_pairs_by_scanning(spark, rows):
    bad = HEAD + "def v():\n    run_it(request.args['q'])\n"
    good = HEAD + "def v():\n    run_it('ls')\n"
    echo = HEAD + "def v():\n    x = wrap(request.args['q'])\n    run_it(x)\n"
    files_ = [("f1/positive/0.py", bad), ("f1/negative/0.py", good), ("f2/positive/0.py", good), ("f2/negative/0.py", bad.replace("run_it", "noisy")), ("f3/positive/0.py", bad.replace("run_it", "noisy")), ("f3/negative/0.py", good), ("f4/positive/0.py", echo)]
    scan = Scan(spark.createDataFrame(files_, "path string, source string"))
    samples = spark.createDataFrame([(f, int(f[1]), f.split("/")[1]) for f, _ in files_], "file string, fam_no int, variant string")
    relevant = scan.program.part("calls").select("file", F.col("callee").alias("name")).join(samples, "file").select("fam_no", "name").distinct()

    def alerts(facts):
        sinks = spark.createDataFrame([("python", c.name, "command", [0], False) for c in facts], "family string, sink string, label string, slots array<int>, receiver boolean")
        found = scan.with_options(ScanOptions(sinks=sinks)).findings
        return mining.family_alerts(found, checks.complexity(scan.program, 10**6), samples)

    kept, lost = mining.replay_gate([mining.Candidate("run_it", "sink"), mining.Candidate("noisy", "sink")], alerts, relevant)
    assert [c.name for c in kept] == ["run_it"] and [(c.name, why) for c, why in lost] == [("noisy", "breaks a family")]
    sinks = spark.createDataFrame([("python", n, "command", [0], False) for n in ("run_it", "wrap")], "family string, sink string, label string, slots array<int>, receiver boolean")
    assert rows(mining.downstream_echoes(scan.with_options(ScanOptions(sinks=sinks)).findings)) == [("run_it", "wrap")]
    lit = mining.literal_arguments(scan.program.part("calls"), scan.program.part("args"))
    assert rows(lit.where("resolved = 'run_it'")) == [("run_it", 0, None, "ls", 3)]
    names_ = spark.createDataFrame([("get",), ("",), ("x",), ("deleteAll",)], "name string")
    assert rows(mining.without_noise(names_)) == [("deleteAll",), ("x",)]


C_SOURCE = """
char *make(int n) {
    char *p = malloc(n);
    return p;
}
void drop(char *q) {
    free(q);
}
void twice(int n) {
    char *a = make(n);
    drop(a);
    free(a);
}
void late(int n) {
    char *a = malloc(n);
    free(a);
    print_it(a);
}
void branches(int n, int c) {
    char *a = malloc(n);
    if (c) {
        free(a);
    } else {
        free(a);
    }
}
void lost(int n) {
    char *a = make(n);
    n = n + 1;
}
void renewed(int n) {
    char *a = malloc(n);
    free(a);
    a = malloc(n);
    free(a);
}
"""


def test_markup_directives_and_taught_keywords(spark, rows):
    jsx = "function V(req) {\n  const q = req.query.q;\n  return <p dangerouslySetInnerHTML={{__html: q}} title={q}></p>;\n}\n"
    assert rows(Scan(spark.createDataFrame([("v.jsx", jsx)], "path string, source string")).findings, "sink", "line", "verdict") == [("dangerouslySetInnerHTML=", 3, "vulnerable")]
    c = lexical.lower("a.c", '#include <stdio.h>\n#define F(x) \\\n  system(x)\nint f(char *a) {\n#if X\n  one(a);\n#else\n  two(a);\n#endif\n}\n')
    assert [(x["callee"], x["line"]) for x in c["calls"]] == [("one", 6), ("two", 8)] and [i["package"] for i in c["imports"]] == ["stdio.h"]
    assert [f["qual"] for f in lexical.lower("a.rs", "fun go(x) { y(x) }", {"fun": "function"})["functions"]] == ["<module>", "go"]


def test_memory_contracts(spark, rows):
    from weirflow.operators import memory

    p = Scan(spark.createDataFrame([("m.c", C_SOURCE)], "path string, source string")).program
    s = memory.summaries(p)
    assert rows(s.fresh) == [("m.c::make",)] and rows(s.consumes) == [("m.c::drop", 0)]
    assert rows(memory.misuse(p, s), "rule", "fn", "line") == [("double_free", "m.c::twice", 12), ("memory_leak", "m.c::lost", 28), ("use_after_free", "m.c::late", 17)]
