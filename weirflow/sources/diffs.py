"""Unified diffs as tables (SRC-12, DIF-01, DIF-02, WIN-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import path_matches
from ..operators.windows import islands


def added_lines(diff: DataFrame, n: str = "n", line: str = "line", scope: str = "diff") -> DataFrame:
    """scope, path and number of each added line; context and removed lines are taken into account.

    ``diff`` holds the lines of patches in order, one patch per ``scope``. A
    deleted file ('/dev/null') has no added lines; a renamed one has its new path.
    """
    w = Window.partitionBy(scope).orderBy(n)
    text = F.col(line)
    # a hunk's own lines may look like file headers, so its length decides where it ends
    hunk = F.regexp_extract(text, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    path = F.regexp_extract(text, r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    header = text.rlike(r"^(?:\+\+\+ |--- |diff |index |rename |new file|deleted file|similarity )")
    rows = diff.withColumn("_path", F.last(F.when(path != "", path), ignorenulls=True).over(w))
    rows = rows.withColumn("_start", F.last(F.when(hunk != "", hunk.cast("int")), ignorenulls=True).over(w))
    rows = rows.withColumn("_hunk", F.sum(F.when((hunk != "") | path.isNotNull() & (path != ""), 1).otherwise(0)).over(w))
    moves = F.when((hunk == "") & ~header & ~text.startswith("-") & ~text.startswith("\\"), 1).otherwise(0)
    rows = rows.withColumn("_moves", F.sum(moves).over(Window.partitionBy(scope, "_hunk").orderBy(n)))
    added = rows.where(text.startswith("+") & ~header & F.col("_start").isNotNull() & (F.col("_path") != "/dev/null"))
    return added.select(scope, F.col("_path").alias("path"), (F.col("_start") + F.col("_moves") - 1).alias("at"))


def added_ranges(diff: DataFrame, n: str = "n", line: str = "line", scope: str = "diff") -> DataFrame:
    """scope, path, start_line, end_line: added lines as merged ranges."""
    one = added_lines(diff, n, line, scope).select(scope, "path", F.col("at").alias("start_line"), F.col("at").alias("end_line"))
    return islands(one, [scope, "path"], "start_line", "end_line")


def in_diff(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings (file_path, line) on added lines; a path matches by a suffix at '/'.

    Both sides meet on the file name, so no pair of different names is formed.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    r = ranges.select(base(F.col("path")).alias("_base"), F.col("path").alias("_path"), "start_line", "end_line")
    on = (base(F.col("file_path")) == F.col("_base")) & path_matches(F.col("file_path"), F.col("_path")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    return findings.join(r, on, "left_semi")
