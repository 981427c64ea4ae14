from __future__ import annotations

import datetime as dt

from weirflow.operators.snapshots import explain_changes, snapshot_changes

SCHEMA = "project string, snap_no int, received_at timestamp, file string, line int, sink string, arg_slot int, func string, verdict string, cut_reasons array<string>, reason string, source_desc string"
T = dt.datetime(2024, 1, 1)
ALL = ["cut_reasons", "func", "reason", "source_desc", "verdict"]


def row(p, n, file="a.py", line=1, sink="s", slot=0, func="f", verdict="clean", cuts=None, reason="r", src=None):
    return (p, n, T, file, line, sink, slot, func, verdict, cuts, reason, src)


def test_added_removed_changed_and_normalised_text(spark, rows):
    data = [
        row("p", 1), row("p", 1), row("p", 1, line=2), row("p", 1, line=3, cuts=["b", "a", "a"]), row("p", 1, line=4, func="old"), row("p", 1, line=5, slot=None),
        row("p", 4, file=".\\a.py", verdict=" CLEAN\t", src=""), row("p", 4, line=3, cuts=["a", None, " b "]), row("p", 4, line=4, func="new"), row("p", 4, line=9), row("p", 4, line=5, slot=None, reason="other"),
        row("p", 4, file=None), row("p", 4, file=" ", line=8), row("p", 4, line=None), row("p", 4, sink=None),
        row("q", 7), row(None, 1), row(None, 2, line=2), row("p", None),
    ]
    out = explain_changes(spark.createDataFrame(data, SCHEMA))
    assert rows(out, "project", "snap_no", "file", "line", "arg_slot", "change_kind", "changed_fields") == sorted(
        [
            ("p", 4, "a.py", 2, 0, "removed", ALL), ("p", 4, "a.py", 4, 0, "changed", ["func"]), ("p", 4, "a.py", 9, 0, "added", ALL), ("p", 4, "a.py", 5, None, "changed", ["reason"]),
            (None, 2, "a.py", 1, 0, "removed", ALL), (None, 2, "a.py", 2, 0, "added", ALL),
        ],
        key=repr,
    )


def test_empty_and_clashing_names(spark, rows):
    assert explain_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("g", 1, 1, "x", "a", 1), ("g", 2, 1, "y", "a", 2)], "g string, v int, k int, f string, field string, _sign int")
    assert rows(snapshot_changes(df, "g", "v", ["k"], ["f"])) == [("g", 2, 1, "changed", ["f"])]


def test_a_record_with_several_values_is_compared_as_a_set(spark, rows):
    df = spark.createDataFrame([("g", 1, 1, "x"), ("g", 1, 1, "y"), ("g", 2, 1, "y"), ("g", 2, 1, "x"), ("g", 3, 1, "x")], "g string, v int, k int, f string")
    assert rows(snapshot_changes(df, "g", "v", ["k"], ["f"])) == [("g", 3, 1, "changed", ["f"])]


def test_a_snapshot_without_records_still_counts(spark, rows):
    data = [row("p", 1), row("p", 2, file=None), row("p", 3)]
    assert rows(explain_changes(spark.createDataFrame(data, SCHEMA)), "snap_no", "change_kind") == [(2, "removed"), (3, "added")]
