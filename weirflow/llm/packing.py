"""Items of varying length into as few containers of a fixed capacity as can be.

Bulk-synchronous best fit. Items are range-sorted by size and get a rank within
their size; the gaps of open containers are kept sorted as runs (gap, first
container, number). A superstep takes all items of one size, largest size
first: a successor sweep over the gaps finds the tightest ones that hold the
size; the items' ranks say which item goes into which container, so no two want
the same place; the gaps are updated and the next superstep follows. Items that
no gap holds open new containers. The result is that of best-fit decreasing.

Sizes and gaps are integers up to the capacity C, so what a sweep looks at is
bounded by C and not by the data: a superstep splits at most one run and opens
at most two, and a run that takes items of size s is left with less than half
its gap, so there are at most 3 C runs and 3 C log2(C) matches (rank range of a
size -> range of containers), one superstep per size. Sweeps over such runs
need no shuffle and run on the driver; everything that grows with the data -
sorting, ranking, splitting, and the search of each item's container in the
matches - runs in the tasks. A size shared by a third of all items is ranked by
its partitions' offsets, never in one task.

Defined cases: an item longer than the capacity is cut into full pieces and the
rest; items without size (null or empty texts) take no space and are put into
container 0; equal sizes are ordered by key; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import write_table

#: Containers of different capacity that one call packs for.
MAX_KINDS = 1_000


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Matches (size, first rank, items per container, first container), and the number of containers.

    ``sizes`` are distinct and from 1 to ``capacity``. Each match holds for the
    ranks up to the next one of its size.
    """
    gap, first, number = (np.zeros(0, dtype=np.int64) for _ in range(3))
    matches: list[tuple[int, int, int, int]] = []
    opened = 0
    for s, n in sorted(zip(sizes.tolist(), counts.tolist(), strict=True), reverse=True):
        rank = 0
        left = n
        at = int(np.searchsorted(gap, s))
        per = gap[at:] // s
        room = np.cumsum(per * number[at:])
        whole = int(np.searchsorted(room, left, side="right"))
        new: list[tuple[int, int, int]] = []
        for j in range(at, at + whole):
            k = int(per[j - at])
            matches.append((s, rank, k, int(first[j])))
            new.append((int(gap[j]) - k * s, int(first[j]), int(number[j])))
            rank += k * int(number[j])
        left = n - rank
        upto = at + whole
        if left and upto < len(gap):
            new += _fill(matches, s, rank, left, int(per[whole]), int(gap[upto]), int(first[upto]), int(number[upto]))
            rank, left, upto = n, 0, upto + 1
        elif left:
            k = capacity // s
            needed = -(-left // k)
            new += _fill(matches, s, rank, left, k, capacity, opened, needed)
            opened += needed
        gap, first, number = (np.concatenate([a[:at], a[upto:]]) for a in (gap, first, number))
        new = sorted(x for x in new if x[0] > 0 and x[2] > 0)
        if new:
            add = np.array(new, dtype=np.int64)
            where = np.searchsorted(gap, add[:, 0])
            gap, first, number = (np.insert(a, where, add[:, i]) for i, a in enumerate((gap, first, number)))
    return np.array(matches, dtype=np.int64).reshape(-1, 4), opened


def _fill(matches: list, s: int, rank: int, left: int, per: int, gap: int, first: int, number: int) -> list[tuple[int, int, int]]:
    """Put ``left`` items into the first containers of one run; the runs it is split into."""
    full, rest = divmod(left, per)
    out = []
    if full:
        matches.append((s, rank, per, first))
        out.append((gap - per * s, first, full))
    if rest:
        matches.append((s, rank + full * per, rest, first + full))
        out.append((gap - rest * s, first + full, 1))
    used = full + bool(rest)
    return [*out, (gap, first + used, number - used)]


def _ranked(items: DataFrame) -> DataFrame:
    """Range-sorted items with the number of their partition and their place among its items of a size."""
    schema = T.StructType([*items.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(names.index("kind")).to_numpy(zero_copy_only=False).astype(np.int64)
            code = (kind << 32) + batch.column(names.index("size")).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            lengths = np.diff(np.r_[starts, len(code)])
            places = np.arange(len(code)) - np.repeat(starts, lengths)
            if last == code[0]:
                places[: lengths[0]] += seen
            last, seen = code[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(places, pa.int64())], names=schema.names)

    return items.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(place, schema)


def pack(sizes: DataFrame, key: str, size: str, containers: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Assign every item to a container of each kind.

    ``sizes`` holds (key, size), one row per item; ``containers`` holds
    (container, capacity), at most MAX_KINDS of them. Result: rows container,
    container_no, key, piece, start, size (``start`` is the piece's offset in its
    item); and for each kind its number of containers and the least possible one.
    """
    kinds = [r for r in containers.where("container is not null and capacity > 0").distinct().orderBy("capacity", "container").limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(r.capacity).cast("bigint").alias("cap")) for i, r in enumerate(kinds)])) if kinds else F.explode(F.expr("cast(array() as array<struct<kind:int,cap:bigint>>)"))
    pieces = F.posexplode(F.when(F.col("n") > F.col("cap"), F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.col("cap"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    items = (
        sizes.select(F.col(key).alias("id"), n.alias("n"))
        .select("id", "n", each.alias("k"))
        .select("id", "n", "k.kind", "k.cap")
        .select("kind", "cap", "id", "n", pieces.alias("piece", "start"))
        .select("kind", F.least(F.col("n") - F.col("start"), F.col("cap")).alias("size"), "id", "piece", "start")
    )
    ranked = write_table(_ranked(items), "items")
    # range-sorted, so there are about as many of these as partitions and sizes together
    counts = ranked.groupBy("kind", "size", "part").agg((F.max("place") + 1).alias("n")).orderBy("kind", "size", "part").collect()
    offsets: dict[tuple[int, int, int], int] = {}
    total: dict[tuple[int, int], int] = {}
    for r in counts:
        offsets[r.kind, r["size"], r.part] = total.get((r.kind, r["size"]), 0)
        total[r.kind, r["size"]] = offsets[r.kind, r["size"], r.part] + r.n
    usage, found = [], {}
    for i, k in enumerate(kinds):
        held = {s: c for (kind, s), c in total.items() if kind == i and s > 0}
        matches, opened = best_fit(np.array(list(held), dtype=np.int64), np.array(list(held.values()), dtype=np.int64), k.capacity)
        starts = np.flatnonzero(np.r_[True, matches[1:, 0] != matches[:-1, 0]]) if len(matches) else []
        found |= {(i, int(m[0, 0])): m[:, 1:] for m in np.split(matches, starts[1:]) if len(m)}
        tokens = sum(s * c for s, c in held.items())
        usage.append({"container": k.container, "capacity": k.capacity, "containers": opened or int((i, 0) in total), "least": -(-tokens // k.capacity), "used": tokens})
    shared = sizes.sparkSession.sparkContext.broadcast((found, offsets))
    names = [k.container for k in kinds]
    key_type = sizes.schema[key].dataType
    schema = T.StructType(
        [T.StructField("container", T.StringType()), T.StructField("container_no", T.LongType()), T.StructField(key, key_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, offsets = shared.value
        for batch in batches:
            kind, size_, ids, piece, start, part, place = batch.columns
            cells = np.stack([a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (kind, size_, part)])
            at = place.to_numpy(zero_copy_only=False)
            no = np.zeros(len(at), dtype=np.int64)
            # sorted by size, so a batch has few stretches of one size
            edges = np.flatnonzero(np.r_[True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)]) if len(at) else []
            for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
                i, s, p = cells[:, a].tolist()
                if s > 0:
                    match = found[i, s]
                    rank = at[a:b] + offsets[i, s, p]
                    m = match[np.searchsorted(match[:, 0], rank, side="right") - 1]
                    no[a:b] = m[:, 2] + (rank - m[:, 0]) // m[:, 1]
            which = pa.array(names, pa.string()).take(kind)
            yield pa.RecordBatch.from_arrays([which, pa.array(no, pa.int64()), ids, piece, start, size_], names=schema.names)

    return ranked.select("kind", "size", "id", "piece", "start", "part", "place").mapInArrow(assign, schema), usage
