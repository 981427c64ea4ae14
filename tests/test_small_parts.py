"""Operators that no query on the driver's tables runs, on small inputs with known answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from weirflow.functions import names, severity, values
from weirflow.operators import intra, joins, mining, report, score
from weirflow.sources import corpus
from weirflow.streaming import watch


def test_corpora(spark, rows, tmp_path):
    (tmp_path / "truth.csv").write_text("# id, category, real, cwe\nc1, sqli, true, CWE-89\nc2, xss, false, CWE-79\n")
    assert rows(corpus.read_cases(spark, str(tmp_path / "truth.csv"))) == [("c1", "sqli", True, "CWE-89"), ("c2", "xss", False, "CWE-79")]
    files = spark.createDataFrame([("a.ts", "x\ny // vuln-code-snippet vuln-line one two\n"), ("b.ts", None)], "path string, source string")
    assert rows(corpus.markers(files)) == [("one", "a.ts", 2), ("two", "a.ts", 2)]
    pins = spark.createDataFrame([("a", "0" * 40), ("b", "main"), ("c", None)], "name string, sha string")
    assert rows(corpus.check_manifest(pins), "name") == [("b",), ("c",)]
    facts = spark.createDataFrame([("sinks", "py", None, k, "{}", 1, 0) for k in "ab"], corpus.FACT_SCHEMA)
    assert rows(corpus.fact_counts(facts)) == [("sinks", 2)]


def test_columns(spark):
    r = spark.range(1).select(
        names.has_hint(F.lit("userPassWord"), ("password", "pin")).alias("a"), names.has_hint(F.lit(None).cast("string"), ("x",)).alias("b"), names.is_null_token(F.lit("nil")).alias("c"),
        values.shift_left((F.lit(1), F.lit(3)), F.lit(4))[1].alias("d"), F.to_json(names.callee_keys(F.lit("a::b.readSync"))).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, True, 48, '["a.b.readSync","b.readSync","readSync","read"]')


def test_rules_have_weaknesses(spark):
    d = severity.rule_dimension(spark)
    assert d.where("cwe = 'CWE-89'").count() == 1 and d.where("broad").select("cwe").distinct().count() <= 3


def test_reports_and_scores(spark, rows):
    card = spark.createDataFrame([("b", 1, 2, 3, 4, 0.25, 0.333), ("(total)", 1, 2, 3, 4, 0.25, 0.333)], "grp string, tp long, fp long, fn long, tn long, tpr double, fpr double")
    assert report.markdown_scorecard(card).splitlines()[2:] == ["| (total) | 1 | 2 | 3 | 4 | 0.250 | 0.333 |", "| b | 1 | 2 | 3 | 4 | 0.250 | 0.333 |"]
    calls = spark.createDataFrame([("a.b", False), ("a.b", False), ("x.run", False), ("go", True), ("bare", False), ("c.d", False)], "callee string, bound boolean")
    out = report.funnel(calls, spark.createDataFrame([("run",)], "sink string"), 1)
    assert rows(out, "stage", "n", "top") == [("local", 1, None), ("not-a-sink", 3, ["a.b"]), ("program-local", 1, None), ("sink", 1, None)]
    flags = spark.createDataFrame([(1, "vulnerable", True), (1, "fixed", False), (2, "vulnerable", True), (2, "fixed", True), (3, "fixed", False)], "pair int, variant string, flagged boolean")
    assert rows(score.pair_gate(flags), "pair", "passed") == [(1, True), (2, False), (3, False)]


def test_learning(spark, rows):
    shown = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a"), ("u", "a")], "trigger string, guard string")
    assert rows(mining.guard_union(shown)) == [("t", ["a", "b"])]
    trial = spark.createDataFrame([(1, True, False, 2), (2, True, True, 2), (3, False, False, 0), (4, False, False, 1)], "fam int, pos boolean, neg boolean, n_candidates int")
    assert rows(mining.teachability(trial), "gap") == [("already separates",), ("negative alerts too",), ("no candidate reaches the positive",), ("no difference in calls",)]
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, "z"), (5, "a")], "k int, m string")
    assert rows(mining.set_relations(sets, "k", "m", 2)) == [(1, 2, "same"), (1, 3, "subset"), (2, 3, "subset")]
    assert mining.set_relations(sets.limit(0), "k", "m").count() == 0


def test_links_are_followed_to_their_end(spark, rows):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "q")], "name string, next string")
    start = spark.createDataFrame([(1, "a"), (2, "c"), (3, "x"), (4, "s"), (5, None)], "id int, name string")
    assert rows(joins.follow_links(start, links, "name", 4), "id", "name", "hops") == [(1, "c", 2), (2, "c", 0), (3, "x", 4), (4, "s", 0), (5, None, 0)]


def test_what_holds_on_every_path(spark, rows):
    cfg = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3), ("f", 3, 3), ("f", 3, 4)], "fn string, src int, dst int")
    facts = spark.createDataFrame([("f", 1, "x", True), ("f", 2, "x", True), ("f", 1, "y", True), ("f", 4, "x", False), ("f", 4, "z", True), ("g", 0, "w", True)], "fn string, block int, fact string, holds boolean")
    assert rows(intra.must_hold(facts, cfg)) == [("f", 1, "x"), ("f", 1, "y"), ("f", 2, "x"), ("f", 3, "x"), ("f", 4, "z"), ("g", 0, "w")]


def test_streams_keep_each_key_once(spark, rows, tmp_path):
    data = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, i)) for i in range(3)] + [("b", dt.datetime(2024, 1, 1))], "k string, at timestamp")
    data.write.parquet(str(tmp_path / "in"))
    once = watch.distinct_within(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "at", ["k"], "1 hour")
    once.select("k").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a",), ("b",)]
