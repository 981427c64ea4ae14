"""Queries on small tables where a narrower job would give other rows."""

from __future__ import annotations

import random

import pytest

from weirflow.functions import text
from weirflow.operators import reach
from weirflow.plans import graphs, texts
from weirflow.scan import Scan, ScanOptions


def test_near_copies_in_any_script(spark, rows, tmp_path):
    zh, ru = "敏捷的棕色狐狸跳过了懒惰的狗，然后回到森林里睡觉。", "Быстрая лиса прыгает через ленивую собаку и уходит в лес, v2."
    docs = [(1, zh, "zh"), (2, zh, "zh"), (3, zh[:-1] + "！", "zh"), (4, "完全不同的一句话与其他文本没有任何关系。", "zh"), (5, ru, "ru"), (6, "Совсем другой текст о погоде, v2.", "ru"), (7, " 　 ", "zh"), (8, None, "zh"), (9, "été à l'école ２ ", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(rows(texts.join20_tokens(spark, str(tmp_path)), "doc_id", "n_links"))
    assert got == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0, 6: 0, 9: 0}
    last = spark.createDataFrame([docs[-1]], "doc_id long, text string, lang string").select(text.text_tokens(text.F.col("text")).alias("t")).first().t
    assert last == ["é", "t", "é", "à", "l", "'", "é", "cole", "２"]


def brute_classes(lines):
    cls = {o: o for o, *_ in lines}
    moved = True
    while moved:
        moved = False
        for o, p, *_ in lines:
            low = min(cls[x] for x, q, *_ in lines if q == p)
            moved, cls[o] = moved or low < cls[o], min(low, cls[o])
    return cls


def test_alias_classes_over_all_lines(spark, rows, tmp_path):
    random.seed(3)
    lines = [(random.randrange(60), random.randrange(50), 0.01 * random.randrange(11), float(random.randrange(1, 51))) for _ in range(70)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brute_classes(lines)
    assert dict(rows(graphs.gr05_whole(spark, str(tmp_path)))) == want and 1 < len(set(want.values())) < len(want)


def test_components_that_still_move_raise(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "node int, next int")
    with pytest.raises(RuntimeError):
        reach.components(e, 1)


def test_receivers_are_reported_if_vulnerable(spark, rows):
    head, tail = "import zipfile\nfrom flask import request\ndef v(open_):\n", "    z.extract_all('x')\n"
    made = {"tainted": "    z = zipfile.ZipFile(request.args['q'])\n", "fixed": "    z = zipfile.ZipFile('a.zip')\n", "open": "    z = open_\n"}
    files = [(f"{n}.py", head + body + tail, ) for n, body in made.items()] + [("a.js", "function go(req) {\n  const z = new Zip(req.query.q);\n  z.extract_all('x');\n}\n")]
    df = spark.createDataFrame(files, "path string, source string")

    def found(slots):
        sinks = spark.createDataFrame([(f, "extract_all", "command", slots, True) for f in ("python", "js")], "family string, sink string, label string, slots array<int>, receiver boolean")
        return rows(Scan(df, ScanOptions(sinks=sinks)).findings, "file", "slot", "verdict")

    args = [(f, 0, "clean") for f in ("a.js", "fixed.py", "open.py", "tainted.py")]
    receivers = [("a.js", -1, "vulnerable"), ("tainted.py", -1, "vulnerable")]
    assert found([]) == sorted(args + receivers, key=repr) and found([-1]) == receivers and found([0]) == args


def test_renamed_copies_are_structural_clones(spark, rows, tmp_path):
    code = "def {0}({1}):\n    {2} = {1} + 1\n    if {2}:\n        return {2}\n    while {1}:\n        {1} = {2} - 3\n    return {1}\n"
    other = "class A:\n    x = [1, 2, 3]\n    y = {'a': x, 'b': not x}\n    z = x[0] * y['a'] / 2 ** 3 % 7 - 1 < 4 > 5 == 6\n"
    copy = code.format("f", "p", "q")
    fams = [(1, "py", [copy]), (2, "py", [None, copy.replace("p", "long_name").replace("q", "other")]), (3, "py", [other]), (4, "py", ["x = 1"]), (5, "js", [copy]), (6, None, None)]
    data = [(n, lang, None if s is None else [(x, "py") for x in s], None) for n, lang, s in fams]
    kind = "array<struct<source:string,ext:string>>"
    spark.createDataFrame(data, f"fam_no long, lang string, positives {kind}, negatives {kind}").write.parquet(f"{tmp_path}/families.parquet")
    assert dict(rows(texts.min11_clones(spark, str(tmp_path)), "fam_no", "n_links")) == {1: 1, 2: 1, 3: 0, 5: 0}


def test_a_bundle_changes_what_a_scan_says(spark, rows):
    from weirflow.sources.corpus import FACT_SCHEMA

    src = "import os, re\nfrom flask import request\ndef a():\n    os.system(tidy(request.args['c']))\ndef b():\n    run_it('x', request.args['c'])\ndef c():\n    os.system(re.sub(request.args['c'], 'x', 'y'))\ndef d(k):\n    wipe()\n    open_door(lock=False)\n"
    df = spark.createDataFrame([("m.py", src)], "path string, source string")
    plain = Scan(df)
    assert rows(plain.findings, "line", "sink", "slot", "verdict") == [(4, "os.system", 0, "vulnerable"), (8, "os.system", 0, "clean")]
    facts = [
        ("sanitizers", "python", None, "tidy", '{"effect": "full"}', 1, 0), ("sinks", "*", None, "run_it", '{"label": "command", "slots": [1]}', 1, 0), ("sinks", "python", None, "run_it", '{"label": "command"}', 1, 1),
        ("policies", "python", None, "wipe", '{"guards": ["check"], "rule": "wipe_unchecked"}', 1, 0), ("named", "*", None, "open_door", '{"name": "lock", "banned": ["False"], "rule": "door_unlocked"}', 1, 0),
        ("propagators", "python", None, "re.sub", '{"slots": [0, 1, 2]}', 1, 0),
    ]
    taught = plain.with_options(ScanOptions(bundle=spark.createDataFrame(facts, FACT_SCHEMA)))
    assert rows(taught.findings, "line", "sink", "slot", "verdict") == [(4, "os.system", 0, "sanitized"), (6, "run_it", 1, "vulnerable"), (8, "os.system", 0, "vulnerable")]
    assert rows(taught.checks.where("rule in ('wipe_unchecked', 'door_unlocked')"), "rule", "line") == [("door_unlocked", 11), ("wipe_unchecked", 10)]
