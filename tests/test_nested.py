from __future__ import annotations

import json

import pytest

from weirflow.operators.nested import child_rows, deep_json, flatten_tables, read_json, report_rows, unread

FINDINGS = "finding_id bigint, cut_reasons array<string>, cut_sites array<struct<kind:string,detail:string>>, position string"
REPORTS = "report_id bigint, kind string, body string"


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame([(1, ["a", None, "b"], [None, ("k", None), ("k", "d")], "x"), (2, None, [], "x"), (3, [], None, None), (None, ["z"], None, None)], FINDINGS)


def test_reports(spark, rows, findings):
    record = {"cut_reasons": "one", "cut_sites": {"detail": "d"}}
    explain = {"groups": [{"files": None}, {"files": [{"records": [{"cut_reasons": [None, "x"]}, record]}, {"records": record}]}]}
    bodies = [
        json.dumps(explain), json.dumps(json.dumps({"by_cwe": {"CWE-1": {"TP": "8"}, "CWE-2": {"TP": None}, "CWE-3": 5, "CWE-4": {"TP": 7.0}}, "baseline": {"by_cwe": {"CWE-9": {"TP": 1}}}})),
        json.dumps({"by_cwe": [{"cwe": "CWE-5", "TP": 2}, {"TP": 1}, None]}), '{"by_cwe": {"CWE-1": ', "", None, "null", "[]", '"x"', json.dumps({"groups": "\ud800"}),
    ]
    out = report_rows(spark.createDataFrame([(i, "explain", b) for i, b in enumerate(bodies)], REPORTS), findings)
    assert rows(out) == sorted(
        [
            ("raw_reports", 0, "cut_reasons", "1.0.0.1", "x"), ("raw_reports", 0, "cut_reasons", "1.0.1.0", "one"), ("raw_reports", 0, "cut_sites", "1.0.1.0", "d"),
            ("raw_reports", 0, "cut_reasons", "1.1.0.0", "one"), ("raw_reports", 0, "cut_sites", "1.1.0.0", "d"), ("raw_reports", 1, "by_cwe", "CWE-1", "8"),
            ("raw_reports", 1, "by_cwe", "CWE-2", ""), ("raw_reports", 1, "by_cwe", "CWE-3", ""), ("raw_reports", 1, "by_cwe", "CWE-4", "7"), ("raw_reports", 2, "by_cwe", "CWE-5", "2"),
            ("sink_findings", 1, "cut_reasons", "0", "a"), ("sink_findings", 1, "cut_reasons", "2", "b"), ("sink_findings", 1, "cut_sites", "1", ""), ("sink_findings", 1, "cut_sites", "2", "d"),
            ("sink_findings", None, "cut_reasons", "0", "z"),
        ],
        key=repr,
    )


def test_children_keep_keys_and_positions(spark, rows, findings):
    assert rows(child_rows(findings, ["finding_id"], "cut_sites")) == [(1, "1", "k", None), (1, "2", "k", "d")]
    clash = child_rows(findings, ["finding_id", "position"], "cut_sites", position="kind")
    assert clash.columns == ["finding_id", "position", "kind", "cut_sites_kind", "detail"]
    assert child_rows(findings.limit(0), ["finding_id"], "cut_reasons").count() == 0


def test_all_tables_of_a_deep_record(spark, rows):
    df = spark.createDataFrame([(1, ("p",), [[(5, ["u", "v"])], None, [(6, None)]])], "id int, head struct<name:string>, a array<array<struct<n:int,tags:array<string>>>>")
    t = flatten_tables(df, ["id"])
    assert set(t) == {"", "a", "a.tags"}
    assert rows(t[""]) == [(1, "p")]
    assert rows(t["a"]) == [(1, "0.0", 5), (1, "2.0", 6)]
    assert rows(t["a.tags"]) == [(1, "0.0.0", "u"), (1, "0.0.1", "v")]


def test_unreadable_and_deep_text(spark, rows):
    assert read_json("[" * 100_000) is None and read_json('{"a":1} x') is None and read_json(json.dumps(json.dumps([1]))) == [1]
    often = '{"a": 1}'
    for _ in range(12):
        often = json.dumps(often)
    assert read_json(often) == {"a": 1}
    deep = '{"by_cwe": {"CWE-1": {"TP": 3}}, "x": ' + "[" * 50_000 + "]" * 50_000 + "}"
    out = report_rows(spark.createDataFrame([(1, "s", deep), (2, "s", often)], REPORTS), spark.createDataFrame([], FINDINGS))
    assert rows(out) == [("raw_reports", 1, "by_cwe", "CWE-1", "3")]
    bodies = ["", None, "  ", "null", "[]", "{", "{}", '"x"', json.dumps("{}"), "5"]
    got = rows(unread(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"), ["k"], "body"))
    assert got == [(0, "missing"), (1, "missing"), (2, "missing"), (3, "no object"), (4, "no object"), (5, "unreadable"), (7, "unreadable"), (9, "no object")]


@pytest.mark.parametrize("text", ['{"a": [1, {"b": null}], "c": "d\\n", "e": -1.5e3}', "[]", "{}", " [ 1 , [ ] ] ", '"s"', "true", "12"])
def test_deep_reader_equals_the_plain_one(text):
    assert deep_json(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "[", "nul", "[]x", "{1:2}", '{"a":1]'])
def test_deep_reader_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        deep_json(text)
