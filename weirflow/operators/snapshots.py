"""What changed between consecutive full snapshots.

Every record of a snapshot has cells (key, field, value) plus one marker that the
key is present. A snapshot contributes its cells with +1 to the transition that
ends in it and with -1 to the one that starts from it. Cells that cancel out are
equal in both; what is left classifies the key: a marker left with +1 is an added
record, with -1 a removed one, and cells left without a marker are changed fields.

The cells of one record travel and are summed side by side, as columns of its row
(one row a cell would be twelve rows for each record of five fields); sums that
are not zero are unpivoted to the names of changed fields. Rows are shuffled once,
by record key; repeated rows, signs and sums all stay in that partitioning.

A value stands as a number of 62 bits: the hash of the least, the largest, the OR
and the AND of the hashes of a record's values in one snapshot. These do not
depend on how often or in what order a row is repeated.

Defined cases: rows with a null key member are no records; a record repeated
within a snapshot counts once; if it is repeated with other values, the values
are compared as sets; null and empty text are the same value if the caller makes
them so; a group with one snapshot has no transitions; an empty table gives an
empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_or_plain, write_table

#: Snapshots (not rows) up to which the list of transitions is broadcast.
MAX_BROADCAST_SNAPSHOTS = 200_000


def transitions(versions: DataFrame) -> DataFrame:
    """_g, _v, _steps: to which transitions (named by their later snapshot) a snapshot adds its cells, with which sign."""
    order = Window.partitionBy("_g").orderBy("_v")
    before, after = F.lag("_v").over(order), F.lead("_v").over(order)
    ends = F.when(before.isNotNull(), F.struct(F.col("_v").alias("at"), F.lit(1).cast("bigint").alias("sign")))
    begins = F.when(after.isNotNull(), F.struct(after.alias("at"), F.lit(-1).cast("bigint").alias("sign")))
    return versions.select("_g", "_v", F.filter(F.array(ends, begins), lambda x: x.isNotNull()).alias("_steps"))


def snapshot_changes(
    rows: DataFrame,
    group: str,
    version: str,
    key: Sequence[str],
    fields: Sequence[str],
    versions: DataFrame | None = None,
) -> DataFrame:
    """One row per added, removed or changed record of each transition.

    ``rows`` holds (group, version, key..., fields...); ``fields`` are
    comparable values (text, numbers or sorted arrays). ``versions`` lists all
    (group, version); by default those of ``rows``. Result: group, version (of
    the later snapshot), key..., change_kind, changed_fields
    (sorted; all of them for an added or removed record).
    """
    keys, cells = [f"_k{i}" for i in range(len(key))], [f"_c{i}" for i in range(len(fields))]
    given = (rows if versions is None else versions).select(F.col(group).alias("_g"), F.col(version).alias("_v")).where("_v is not null").distinct()
    steps = small_or_plain(write_table(transitions(given), "steps"), MAX_BROADCAST_SNAPSHOTS)
    there = reduce(Column.__and__, [F.col(c).isNotNull() for c in (version, *key)])
    named = [F.col(group).alias("_g"), F.col(version).alias("_v"), *[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)]]
    placed = rows.where(there).select(*named, *[F.xxhash64(F.col(f), F.col(f).isNull()).alias(c) for f, c in zip(fields, cells, strict=True)]).repartition("_g", *keys)
    value = lambda c: F.shiftright(F.xxhash64(F.min(c), F.max(c), F.bit_or(c), F.bit_and(c)), 2)
    once = placed.groupBy("_g", *keys, "_v").agg(*[value(c).alias(c) for c in cells])
    signed = once.withColumnRenamed("_g", "_p").withColumnRenamed("_v", "_w").join(steps, F.col("_p").eqNullSafe(F.col("_g")) & (F.col("_w") == F.col("_v")))
    signed = signed.select("_p", *keys, *cells, F.explode("_steps").alias("_s")).select("_p", *keys, *cells, "_s.at", "_s.sign")
    # two rows at most have one key and transition, so the sums stay within 63 bits
    left = signed.groupBy("_p", *keys, "at").agg(F.sum("sign").alias("_m"), *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in cells])
    moved = [(F.col(c) != 0) | (F.col("_m") != 0) for c in cells]
    changed = F.filter(F.array(*[F.when(m, F.lit(f)) for f, m in sorted(zip(fields, moved, strict=True), key=lambda x: x[0])]), lambda x: x.isNotNull())
    return left.where(reduce(Column.__or__, moved, F.col("_m") != 0)).select(
        F.col("_p").alias(group), F.col("at").alias(version), *[F.col(k).alias(c) for c, k in zip(key, keys, strict=True)],
        F.when(F.col("_m") > 0, "added").when(F.col("_m") < 0, "removed").otherwise("changed").alias("change_kind"),
        changed.alias("changed_fields"),
    )


#: Characters that are trimmed from the ends of texts (fixed values: Unicode's white space and the ASCII separators).
ASCII_WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33)]))
WHITE = ASCII_WHITE + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind; trimming costs its characters, and ASCII texts need few."""
    return F.when(F.octet_length(c) == F.char_length(c), F.btrim(c, F.lit(ASCII_WHITE))).otherwise(F.btrim(c, F.lit(WHITE)))


def explain_changes(snapshots: DataFrame) -> DataFrame:
    """The changes of explain snapshots, texts and paths normalised first.

    ``\\`` in a path is ``/`` and a leading ``./`` is dropped; outer white space
    of texts is ignored, of verdicts the letter case too; null and empty texts
    and null and empty reason sets are equal. An arg_slot that is null is a
    value of its own.
    """
    t = snapshots.select("snap_no", "line", "arg_slot", "cut_reasons", *[trimmed(F.col(c)).alias(c) for c in ("project", "file", "sink", "func", "verdict", "reason", "source_desc")])
    none = F.array().cast("array<string>")
    # most rows have one reason at most and no odd path
    there = F.filter(F.transform("cut_reasons", trimmed), lambda x: x.isNotNull() & (x != ""))
    reasons = F.when(F.size("cut_reasons") > 1, F.array_sort(F.array_distinct(there))).when(F.size("cut_reasons") > 0, there).otherwise(none)
    path = F.when(F.contains("file", F.lit("\\")), F.translate("file", "\\", "/")).otherwise(F.col("file"))
    t = t.withColumns({"file": path, "cut_reasons": reasons, **{c: F.coalesce(c, F.lit("")) for c in ("func", "verdict", "reason", "source_desc")}})
    none_if_empty = lambda c: F.when(c != "", c)
    rows = t.select(
        "project", "snap_no", none_if_empty(F.when(F.col("file").startswith("./"), F.regexp_replace("file", "^(\\./)+", "")).otherwise(F.col("file"))).alias("file"), "line",
        none_if_empty(F.col("sink")).alias("sink"), F.coalesce("arg_slot", F.lit(-(2**31))).alias("arg_slot"),
        "func", F.lower("verdict").alias("verdict"), "reason", "source_desc", "cut_reasons",
    )
    changes = snapshot_changes(rows, "project", "snap_no", ["file", "line", "sink", "arg_slot"], ["func", "verdict", "reason", "source_desc", "cut_reasons"])
    return changes.withColumn("arg_slot", F.when(F.col("arg_slot") != -(2**31), F.col("arg_slot")))
