"""A small program of our own with known answers, in several languages.

The driver's tables hold no sources, sinks or allocators; the queries here run
the frontends, the walk, the checks and the memory contracts on these files, and
their SQL lists what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, memory
from ..scan import Scan
from .base import Book

book = Book()

_PYTHON = """import os, shlex, hashlib
from flask import request
from app.util import build

def direct():
    os.system(request.args['c'])

def quoted():
    os.system(shlex.quote(request.args['c']))

def fixed():
    os.system('ls')

def passed(c):
    os.system(c)

def built():
    os.popen(build(request.args['c']))

def checked():
    c = request.args['c']
    if c not in ('a', 'b'):
        return
    os.system(c)

def weak(password):
    return hashlib.md5(password)

class Job:
    def go(self, c):
        os.system(c)

def method():
    Job().go(request.form['c'])

def stranger(job):
    job.go(request.form['d'])
"""

_SCRIPT = """import { exec } from 'child_process';
import { wrap } from './lib';

export function direct(req: Request): void {
  const { q } = req.query;
  exec(`ls ${q}`);
}
function run(cb: (x: string) => void, v: string) {
  cb(v);
}
export const called = (req) => {
  run((x) => exec(x), req.query.q);
};
export function chosen(req) {
  const kinds = { a: 'ls', b: req.query.q };
  exec(kinds.a);
  exec(kinds['b']);
}
export function imported(req) {
  exec(wrap(req.body.c));
}
export function guarded(req) {
  const c = req.query.c;
  if (!isAllowed(c)) { return; }
  exec(c);
}
class Box {
  run(c) { exec(c); }
}
export function boxed(req) {
  const box = new Box();
  box.run(req.query.c);
}
"""

_COMPONENT = """<template>
  <div ref="out" />
</template>
<script>
export default {
  methods: {
    show(req) {
      this.$refs.out.innerHTML = req.body.html;
    },
  },
};
</script>
"""

_C = """#include <stdlib.h>
char *make(int n) {
  char *p = malloc(n);
  return p;
}
void drop(char *p) {
  free(p);
}
void twice(int n) {
  char *p = make(n);
  drop(p);
  free(p);
}
int late(int n) {
  char *p = malloc(n);
  free(p);
  touch(p);
  return 0;
}
void lost(int n) {
  char *p = malloc(n);
}
"""

FILES = (
    ("app/run.py", _PYTHON), ("app/util.py", "def build(x):\n    return 'ls ' + x\n"), ("web/a.ts", _SCRIPT), ("web/lib/index.ts", "export { prefix as wrap } from './impl';\n"),
    ("web/lib/impl.ts", "export function prefix(x) {\n  return 'ls ' + x;\n}\n"), ("web/view.vue", _COMPONENT), ("mem/m.c", _C), ("bad.py", "def (:\n"), ("odd.js", "let a = ;\neval(location.hash);\n"),
)


def scan(spark: SparkSession) -> Scan:
    return Scan(spark.createDataFrame(list(FILES), "path string, source string"))


def _values(columns: str, rows: list[tuple]) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(repr(v) if v is not None else 'null' for v in r) + ')' for r in rows)}) t({columns})"


VERDICTS = [
    ("app/run.py", 6, "os.system", "vulnerable"), ("app/run.py", 9, "os.system", "sanitized"), ("app/run.py", 12, "os.system", "clean"), ("app/run.py", 15, "os.system", "unknown"),
    ("app/run.py", 18, "os.popen", "vulnerable"), ("app/run.py", 24, "os.system", "clean"), ("app/run.py", 31, "os.system", "vulnerable"), ("odd.js", 2, "eval", "vulnerable"),
    ("web/a.ts", 6, "child_process.exec", "vulnerable"), ("web/a.ts", 12, "child_process.exec", "vulnerable"), ("web/a.ts", 16, "child_process.exec", "clean"), ("web/a.ts", 17, "child_process.exec", "vulnerable"),
    ("web/a.ts", 20, "child_process.exec", "vulnerable"), ("web/a.ts", 25, "child_process.exec", "clean"), ("web/a.ts", 28, "child_process.exec", "vulnerable"), ("web/view.vue", 8, "innerHTML=", "vulnerable"),
]


@book.query("code_verdicts", _values("file, line, sink, verdict", VERDICTS))
def code_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict of every sink argument of the program."""
    return scan(spark).findings.where("slot >= 0 and family <> 'c'").select("file", "line", "sink", "verdict")


CHECKS = [("app/run.py", 27, "credential_kdf_policy"), ("app/run.py", 27, "weak_hash")]


@book.query("code_checks", _values("file, line, rule", CHECKS))
def code_checks(spark: SparkSession, d: str) -> DataFrame:
    """What the registered checks say of the program."""
    return checks.run(scan(spark).program).select("file", "line", "rule")


MEMORY = [("mem/m.c", 12, "double_free"), ("mem/m.c", 17, "use_after_free"), ("mem/m.c", 21, "memory_leak")]


@book.query("code_memory", _values("file, line, rule", MEMORY))
def code_memory(spark: SparkSession, d: str) -> DataFrame:
    """Double releases, uses after release and leaks, through functions that allocate and release."""
    return memory.misuse(scan(spark).program).select("file", "line", "rule")


BINDINGS = [
    ("app/run.py", 18, "build", "app/util.py::build"), ("app/run.py", 34, "Job().go", "app/run.py::Job.go"), ("mem/m.c", 10, "make", "mem/m.c::make"), ("mem/m.c", 11, "drop", "mem/m.c::drop"),
    ("web/a.ts", 9, "cb", "web/a.ts::called.<fn2>"), ("web/a.ts", 12, "run", "web/a.ts::run"), ("web/a.ts", 20, "wrap", "web/lib/impl.ts::prefix"), ("web/a.ts", 32, "Box().run", "web/a.ts::Box.run"),
]


@book.query("code_bindings", _values("file, line, callee, target", BINDINGS))
def code_bindings(spark: SparkSession, d: str) -> DataFrame:
    """The calls that are bound, with their functions: by name, import, re-export, class and callback."""
    p = scan(spark).program
    calls = p.part("calls").where("not again").select("call", "file", "line", "callee")
    return calls.join(p.bindings.select("call", F.col("callee").alias("target")), "call").select("file", "line", "callee", "target")


INVENTORY = [
    ("app/run.py", False, False, 11), ("app/util.py", False, False, 2), ("bad.py", True, False, 0), ("mem/m.c", False, True, 6), ("odd.js", False, True, 1),
    ("web/a.ts", False, False, 10), ("web/lib/impl.ts", False, False, 2), ("web/lib/index.ts", False, False, 1), ("web/view.vue", False, False, 2),
]


@book.query("code_inventory", _values("file, failed, partial, n_functions", INVENTORY))
def code_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files, those that could not be read or only in part, and their functions (the module's body is one)."""
    return scan(spark).program.lowered.select("file", F.col("error").isNotNull().alias("failed"), "partial", F.size("functions").alias("n_functions"))
