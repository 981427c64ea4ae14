from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weirflow.functions import names, severity, text, values
from weirflow.operators import joins, mining, policy, reach, score, windows
from weirflow.operators.similarity import alike, link_counts, shingle_sets
from weirflow.sources import corpus, diffs, files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_names(spark):
    lit = F.lit
    r = one(
        spark, a=names.last_segment(lit("std::fs::read")), b=names.last_segment(lit("a.b.c")), c=names.strip_quotes(lit("'x'")), d=names.strip_quotes(lit("'x\"")), e=names.mirror_base(lit("readFileSync")),
        f=names.mirror_base(lit("Sync")), g=names.callee_matches(lit("extract"), lit("zip.extractAsync")), h=names.callee_matches(lit("a.b"), lit("x.a.b")), i=names.callee_matches(lit("a.b"), lit("xa.b")),
        j=names.path_matches(lit("src/app/a.py"), lit("app/a.py")), k=names.package_prefixes(lit("@s/pkg/sub")), m=names.fields_match(lit("*"), lit("q")), n=names.normalize_package(lit("node:fs")),
        o=names.callee_matches(lit("a"), lit(None).cast("string")),
    )
    assert [r[k] for k in "abcdefghijkmno"] == ["read", "c", "x", "'x\"", "readFile", None, True, True, False, True, ["@s/pkg/sub", "@s/pkg"], True, "fs", r["o"]]


def test_source_paths(spark, rows):
    paths = spark.createDataFrame([("req.body.a",), ("req",), ("ctx.env",), ("ctx.state.x",), ("other",), (None,)], "p string")
    rules = spark.createDataFrame([("req",), ("ctx",), ("ctx.state",)], "s string")
    assert rows(names.source_path_matches(paths, "p", rules, "s")) == [("ctx.state.x",), ("req",), ("req.body.a",)]


def test_intervals_saturate(spark):
    big = (F.lit(2**62), F.lit(2**63 - 1))
    r = one(spark, a=values.add(big, big)[1], b=values.mul(big, (F.lit(-2), F.lit(3)))[0], c=values.mul(big, (F.lit(-2), F.lit(3)))[1], d=values.sub((F.lit(-5), F.lit(1)), big)[0],
            e=values.compare("<", (F.lit(1), F.lit(2)), (F.lit(3), F.lit(4))), f=values.compare("==", (F.lit(1), F.lit(2)), (F.lit(2), F.lit(4))), g=values.rate(F.lit(0), F.lit(0)), h=values.intersect((F.lit(1), F.lit(2)), (F.lit(5), F.lit(6)))[0])
    assert r == {"a": 2**63 - 1, "b": -(2**63), "c": 2**63 - 1, "d": -(2**63), "e": True, "f": None, "g": 0.0, "h": 1}


def test_text(spark):
    src = "// c\nint f(a) { g.h(1); if (x) {} }\n# keep"
    df = spark.createDataFrame([(src, "c")], "s string, e string").withColumn("t", text.code_of(F.col("s"), F.col("e")))
    r = df.select(text.called_names(F.col("t")).alias("calls"), text.skeleton_of(F.col("t")).alias("k"),
                  text.canonical_cwe(F.lit(" cwe-022 ")).alias("cwe"), text.advisory_ids(F.lit("see cve-2024-12345, GHSA-aaaa-bbbb-cccc")).alias("ids"), text.line_at(F.lit("a\nb\nc"), F.lit(4)).alias("line"), text.column_at(F.lit("a\nbc"), F.lit(3)).alias("column")).first()
    assert r.calls == ["f", "h"] and r.k[:4] == ["ID", "f", "(", "ID"] and r.cwe == "CWE-22" and r.ids == ["CVE-2024-12345", "GHSA-AAAA-BBBB-CCCC"] and r.line == 3 and r.column == 2


@pytest.mark.parametrize(("code", "want"), [
    ("x1 = 0x1F + 1.5.2", "ID = NUM ID + NUM . NUM"), ("a = \"b(1) \\\" c\" + 'd' + `e\nf`", "ID = STR + STR + STR"), ("if (sha256(z9)) return nil", "if ( sha256 ( ID ) ) return nil"),
    ("don't f (", "ID ' ID f ("), ("iffy else9 NUM 0", "ID ID ID NUM"), ("é = 5", "é = NUM"),
])
def test_skeletons(spark, code, want):
    assert " ".join(one(spark, k=text.skeleton_of(F.lit(code)))["k"]) == want


def test_comments_are_no_code(spark):
    of = lambda s, e: one(spark, c=text.code_of(F.lit(s), F.lit(e)))["c"]
    assert of("a\n  // x\n\n b /* c\n d */ e\n# k", "js") == "a\n b   e\n# k" and of("# x\na # y\n  #z\n", "py") == "a # y" and of("", "py") == "" and of(None, "py") is None


def test_text_for_reports(spark):
    r = one(spark, a=text.scrub(F.lit("Bad  call (learned from corpus x) family:foo end")), b=text.path_shape(F.array(F.struct(F.lit("call").alias("kind"), F.lit("f").alias("func"), F.lit(3).alias("line")))), c=text.path_shape(F.array(F.struct(F.lit("call").alias("kind"), F.lit("f").alias("func"), F.lit(9).alias("line")))))
    assert r["a"] == "Bad call end" and r["b"] == r["c"]


def test_severity(spark):
    r = one(spark, a=severity.parse_label(F.lit(" HIGH ")), b=severity.parse_label(F.lit("odd")), c=severity.defeats(F.lit("sql_parameterize"), F.lit("execution"), F.lit("sql")),
            d=severity.defeats(severity.sanitizer_kind(F.lit("nonsense")), F.lit("xss"), F.lit("xss")), e=severity.rule_of(F.lit(None).cast("string"), F.lit("execution")), f=severity.rule_of(F.lit("sql"), F.lit("execution"), F.lit(True)))
    assert list(r.values()) == ["warning", None, True, False, "taint.code-injection", "taint.insecure-direct-object-reference"]


def brute_reach(edges, roots, stops):
    out = set()
    for r, n in roots:
        todo, seen = [n], {n}
        while todo:
            x = todo.pop()
            out.add((r, x))
            for a, b in edges:
                if a == x and b not in seen and x not in stops:
                    seen.add(b)
                    todo.append(b)
    return sorted(out, key=repr)


def test_reach_with_cycles_stops_and_repeats(spark, rows):
    random.seed(5)
    edges = [(random.randrange(12), random.randrange(12)) for _ in range(30)] * 2 + [(None, 1), (1, None)]
    roots, stops = [(0, 0), (1, 3), (2, 3), (3, 99)], {4, 7}
    e = spark.createDataFrame(edges, "node int, next int")
    got = reach.reach(spark.createDataFrame(roots, "root int, node int"), e, spark.createDataFrame([(s,) for s in stops], "node int"), with_parent=True)
    assert rows(got, "root", "node") == brute_reach([x for x in edges if None not in x], roots, stops)
    assert reach.reach(spark.createDataFrame([], "root int, node int"), e).count() == 0
    goal = got.where("root = 0 and depth > 0")
    for root, node, path in rows(reach.paths(got, goal)):
        assert path[0] == node and path[-1] == 0 and all((b, a) in set(edges) for a, b in zip(path, path[1:], strict=False)) and root == 0


def test_context_returns_to_its_own_site(spark, rows):
    e = [("r1", "ret", "enter", "s1"), ("r2", "ret", "enter", "s2"), ("ret", "par", "flow", None), ("par", "a1", "leave", "s1"), ("par", "a2", "leave", "s2")]
    got = reach.reach_in_context(spark.createDataFrame([("x", "r1"), ("y", "par")], "root string, node string"), spark.createDataFrame(e, "node string, next string, kind string, site string"))
    assert rows(got.where("node in ('a1', 'a2')"), "root", "node") == [("x", "a1"), ("y", "a1"), ("y", "a2")]


def test_components(spark, rows):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (50, 50)], "node int, next int")
    got = dict(rows(reach.components(e)))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100 and got[50] == 50


def test_policies(spark, rows):
    df = spark.createDataFrame([("u", 1, "guard"), ("u", 2, "act"), ("v", 1, "act"), ("v", 2, "guard"), ("w", 1, None), ("w", 2, "act"), (None, 1, "act")], "who string, i int, name string")
    at = policy.Sequenced(("who",), ("i",))
    go = lambda *r: rows(policy.violations(df, at, F.col("name") == "act", r), "who", "i")
    need = policy.Requirement
    assert go(need("guard_call", ("guard",))) == sorted([("v", 1), ("w", 2), (None, 1)], key=repr)
    assert go(need("not_call", ("guard",))) == [("u", 2), ("v", 1)]
    assert go(need("guard_call", ("guard",), module=True)) == []
    assert len(go()) == 4
    assert go(need("range_check", column="i", low=2)) == sorted([("v", 1), (None, 1)], key=repr)


def test_windows_and_joins(spark, rows):
    r = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 2, 2), ("a", 9, 9), ("b", 1, 1)], "k string, lo int, hi int")
    m = windows.islands(r, ["k"], "lo", "hi")
    assert rows(m) == [("a", 1, 5), ("a", 9, 9), ("b", 1, 1)]
    p = spark.createDataFrame([("a", 5), ("a", 6), ("a", 9), ("b", 2), (None, 1)], "k string, at int")
    assert rows(joins.in_ranges(p, m, ["k"], "at", "lo", "hi", 2)) == [("a", 5), ("a", 9)]
    q = spark.createDataFrame([("a", 7)], "k string, at int")
    assert rows(joins.band(p, q, ["k"], "at", 2)) == [("a", 5), ("a", 6), ("a", 9)]
    assert len(rows(joins.band(p, q, ["k"], "at", 2, "left_anti"))) == 2
    s = spark.createDataFrame([(1, "x", 10), (1, "*", 11), (2, "x", 12)], "o int, f string, s int")
    ld = spark.createDataFrame([(1, "x", 20), (1, "y", 21), (1, "*", 22), (2, "*", 23)], "o int, f string, l int")
    brute = sorted((a, b) for o, f, a in [tuple(x) for x in s.collect()] for o2, f2, b in [tuple(x) for x in ld.collect()] if o == o2 and (f == f2 or "*" in (f, f2)))
    assert rows(joins.wildcard_pairs(s, ld, ["o"], "f", "s", "l")) == brute
    c = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, None), ("u", 5, "a")], "u string, i int, w string")
    assert rows(windows.compact(c, ["u"], ["i"], ["w"]), "i") == [(1,), (3,), (5,)]
    f = spark.createDataFrame([("k", 1, 5, "old"), ("k", 2, 5, "new"), ("k", 0, 1, "x")], "key string, prov int, seq int, v string")
    assert rows(windows.upsert_by_provenance(f, ["key"], "prov", "seq"), "v") == [("new",)]


def test_diffs(spark, rows):
    patch = ["--- a/x.py", "+++ b/x.py", "@@ -1,2 +1,3 @@", " a", "+b", "+--c", "-++ d", "@@ -9,0 +20 @@", "+z", "--- a/y", "+++ /dev/null", "@@ -1 +0,0 @@", "-q"]
    d = spark.createDataFrame([("p", i, x) for i, x in enumerate(patch)], "diff string, n int, line string")
    r = diffs.added_ranges(d)
    assert rows(r, "path", "start_line", "end_line") == [("x.py", 2, 3), ("x.py", 20, 20)]
    f = spark.createDataFrame([("src/x.py", 3), ("src/x.py", 4), ("zx.py", 3)], "file_path string, line int")
    assert rows(diffs.in_diff(f, r)) == [("src/x.py", 3)]


def test_files_and_corpus(spark, rows, tmp_path):
    for path, body in {"a/x.py": "print(1)", "node_modules/y.js": "1", "b/z.rb": "1", ".hid/q.py": "1", "c/m.min.js": "1", "c/big.js": "x" * 3000, "tests/t.go": "package t", "n.txt": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    got = files.read_files(spark, str(tmp_path))
    assert rows(got, "path", "family", "supported") == sorted([("a/x.py", "python", True), ("b/z.rb", None, False), ("tests/t.go", "go", True)], key=repr)
    assert rows(files.skipped_languages(got)) == [("Ruby", 1)]
    c = spark.createDataFrame([("p/foo_positive.py", "python"), ("p/foo_negative.py", "python"), ("p/foo_positive.js", "js"), ("p/bar_heldout_positive_2.py", "python"), ("p/z.py", "python")], "path string, family_lang string")
    assert rows(corpus.group_families(c), "family", "variant", "heldout") == [("bar_heldout", "positive", True), ("foo.js", "positive", False), ("foo.python", "negative", False), ("foo.python", "positive", False)]
    b = one(spark, m=corpus.header_block(F.lit("# [weirflow]\n# cwe: 22\n# cwe: 9\n# x\n# class: a: b\n")))
    assert b["m"] == {"cwe": "22", "class": "a: b"}
    facts = spark.createDataFrame([("sinks", "py", None, "eval", "{}", 1, 0)], corpus.FACT_SCHEMA)
    corpus.write_bundle(facts, str(tmp_path / "b"), ["sinks"])
    assert corpus.read_bundle(spark, str(tmp_path / "b"), ["sinks"]).count() == 1
    with pytest.raises(ValueError):
        corpus.read_bundle(spark, str(tmp_path / "b"), ["sinks", "other"])


def test_mining_and_scores(spark, rows):
    calls = spark.createDataFrame([(1, "py", "positive", "bad"), (1, "py", "negative", "safe"), (2, "py", "positive", "bad"), (2, "py", "positive", "ok"), (2, "py", "negative", "ok"), (3, "py", "negative", "noisy"), (4, "py", "positive", "noisy")], "fam_no int, lang string, variant string, name string")
    assert rows(mining.votes(mining.proposals(calls), ["name", "kind"])) == [("bad", "sink", 2, "confirmed"), ("noisy", "sanitizer", 1, "provisional"), ("noisy", "sink", 1, "provisional"), ("safe", "sanitizer", 1, "provisional")]
    assert rows(mining.independent_gate(calls, ["name"]), "name") == [("bad",)]

    def alerts(facts):
        names_ = [c.name for c in facts]
        hit = lambda v: F.coalesce(F.bool_or((F.col("variant") == v) & F.col("name").isin(*names_)), F.lit(False)) if names_ else F.lit(False)
        return calls.groupBy("fam_no").agg(hit("positive").alias("pos"), hit("negative").alias("neg"))

    good, bad = mining.replay_gate([mining.Candidate("noisy", "sink"), mining.Candidate("bad", "sink"), mining.Candidate("ok", "sink")], alerts, calls)
    assert [c.name for c in good] == ["bad"] and {c.name: why for c, why in bad} == {"noisy": "breaks a family", "ok": "separates no family"}
    cases = spark.createDataFrame([("1", True, "CWE-1"), ("2", False, "CWE-1"), ("3", True, "CWE-2"), ("4", True, "CWE-2")], "id string, vulnerable boolean, cwe string")
    res = spark.createDataFrame([("1", 1, None), ("2", 1, None), ("3", 1, None), ("4", 0, "x")], "id string, findings long, error string")
    named = spark.createDataFrame([("1", "CWE-1"), ("3", "CWE-9")], "id string, cwe string")
    s = score.scorecard(score.classify(cases, res, named))
    assert rows(s.where("grp = '(total)'"), "tp", "fp", "fn", "tn", "err", "score") == [(1, 1, 1, 0, 1, -0.5)]
    steps = spark.createDataFrame([("a", 0, "start", True), ("a", 1, "rename", True), ("a", 2, "alias", False), ("a", 3, "x", False)], "case string, step int, name string, flagged boolean")
    assert rows(score.first_flip(steps)) == [("a", 2, "alias")]


def test_alike_against_brute_force(spark, rows):
    random.seed(11)
    base = [[random.choice("abcdefghij") + str(random.randrange(9)) for _ in range(30)] for _ in range(6)]
    docs = [(i, " ".join(w if random.random() > 0.02 else "zz" for w in random.choice(base))) for i in range(60)] + [(100, ""), (101, None), (102, "solo"), (103, "solo")]
    df = spark.createDataFrame(docs, "id int, t string")
    members, pairs = alike(shingle_sets(df.where("t is not null"), "id", text.words(F.col("t")), 5), 4, 5)
    got = dict(rows(link_counts(members, pairs), "id", "n_links"))
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        if w:
            sets[i] = set(w) if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {i: sum(5 * len(a & b) >= 4 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    assert got == want


def test_lint_of_header_blocks(spark, rows):
    classes = spark.createDataFrame([("a", ["CWE-1"])], "id string, cwes array<string>")
    good = {"observation": "o" * 20, "impact": "i" * 20, "improvement": "m" * 20, "cwe": "cwe-001", "severity": " High ", "class": "a", "purpose": "anchor", "shape": "s", "cvss": "9.8"}
    bad = {**good, "observation": "TODO" + "o" * 20, "cwe": "79", "severity": "odd", "cvss": "11", "class": "z", "purpose": "x", "extra": "1"}
    df = spark.createDataFrame([(1, good, "a.check_owner"), (2, bad, "fake_run"), (3, None, "x.get"), (4, {**good, "cwe": "CWE-2"}, None)], "k int, meta map<string,string>, declared_check_call string")
    got = {}
    for k, code, detail in rows(mining.lint_metadata(df, classes, "k")):
        got.setdefault(k, []).append((code, detail))
    assert 1 not in got and got[4] == [("C003", "CWE-2")]
    assert [c for c, _ in got[2]] == ["C002", "C005", "D005", "M002", "M003", "M004", "M005", "M006"]
    assert [c for c, _ in got[3]] == ["C001", "C005", "C006", "E040"] + ["M001"] * 5


@pytest.mark.parametrize("limit", [0, 3])
def test_walks_without_broadcasts(spark, rows, monkeypatch, limit):
    """Long chains, cycles and paths come out alike where nothing, or only a few new states, may be broadcast."""
    monkeypatch.setattr(reach, "MAX_BROADCAST_EDGES", limit)
    chain = [(i, i + 1) for i in range(23)] + [(23, 4), (7, 2)]
    got = reach.reach(spark.createDataFrame([(0, 0), (1, 20)], "root int, node int"), spark.createDataFrame(chain, "node int, next int"), with_parent=True)
    assert rows(got, "root", "node") == sorted([(0, n) for n in range(24)] + [(1, n) for n in range(2, 24)], key=repr)
    assert {(r.node, r.depth) for r in got.where("root = 0").collect()} == {(n, n) for n in range(24)}
    (path,) = rows(reach.paths(got, got.where("root = 0 and node = 23")), "path")
    assert path[0] == list(range(23, -1, -1))
    e = [(f"n{a}", f"n{b}", "flow", None) for a, b in chain]
    states = reach.reach_in_context(spark.createDataFrame([("r", "n0")], "root string, node string"), spark.createDataFrame(e, "node string, next string, kind string, site string"))
    assert rows(states, "node", "depth") == sorted([(f"n{n}", n) for n in range(24)], key=repr)
