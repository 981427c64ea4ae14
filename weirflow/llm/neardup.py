"""Records whose n-gram sets are alike, without comparing all pairs.

Each text is tokenised once: its record's set of token n-grams (64-bit hashes) is
written, together with a count sketch of the grams. The sets are then ordered
rare-first: by the sketched document frequency, then by the gram itself. Two sets
with a Jaccard similarity of at least t must share a gram within their prefixes
in this order, so only prefixes are joined, on the gram: they are partitioned and
sorted by gram, and each run of one gram pairs its members in blocks. A pair is
kept if it passes

* the length filter: the smaller set has at least t times the larger one's size,
* the positional filter: what lies behind the shared gram can still give the
  overlap needed,
* prefixes are SHARED - 1 grams longer than one common gram would need, so a
  pair must share SHARED grams in them (or all that it needs, if fewer),
* the suffix filter, before any set is moved: the counts of both sets in ranges
  of the gram space (SUFFIX_RANGES bytes a set) bound the overlap from above,

and each pair left is verified once, exactly, on the whole sets: one set of each
class goes to the partition of its class, the smaller set of a pair travels to
the larger one's. A gram that very many sets have (by the sketch) is salted, so
no task gets all of its pairs.

The sketch has 2**SKETCH_BITS buckets whatever the data, one byte each once it is
merged (a logarithm of the count), so what is broadcast has a proven size. Tasks
write theirs in compressed slices, which are merged slice by slice.

Records with equal sets form a class and take part once, however many there
are: copies fall together in each task and again where grams are sorted. Results
come as pairs of classes plus membership; ``expand`` makes pairs of records of
them, block by block, where such are asked for.

Defined cases: null, empty and blank sources have no grams, a source with fewer
than n tokens has none; records with an empty set, and records without an id,
are in no pair; repeated records are copies; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small_or_plain, write_table

SKETCH_BITS = 22
#: Slices in which tasks write their sketch.
SLICES = 64
#: Buckets' counts are kept as 1 + CODE * log2(count), rounded.
CODE = 8
#: Grams that two prefixes must have in common; prefixes are that much longer.
SHARED = 8
#: Estimated frequency that one task takes of a gram; grams of more are salted.
HOT = 4_000
#: Ranges of the gram space that the suffix filter compares.
SUFFIX_RANGES = 32
#: Candidate pairs, or classes of them, up to which they are broadcast (under 100 bytes each).
MAX_BROADCAST_MEMBERS = 500_000
#: Bound of a worker's memory of the sets it has written.
MAX_SENT = 500_000
#: Pairs that are made at a time, and copies of one class that are paired in one block.
BLOCK_PAIRS, BLOCK_COPIES = 1_000_000, 2_000

#: Bytes of text that are tokenised at a time; a longer record is taken alone.
CHUNK_BYTES = 1_500_000

_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
#: White space beyond ASCII, as code points (fixed values).
_WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[_SPACES] = True
#: Bytes of the character that a leading byte starts; 0 for those within a character.
_LENGTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class GramSets:
    """Sets of hashed token n-grams, taken from the buffers of Arrow batches.

    A token is a run of ASCII letters, digits and underscores, or another single
    character that is not white space. The bytes of many texts are classified at
    once, a token's hash is the difference of two running sums of a polynomial
    hash, and a gram's hash mixes those of its tokens; no token becomes an object.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        rng = np.random.default_rng(20240229)
        self._factors = rng.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._up = self._down = np.zeros(0, dtype=np.uint64)

    def tokens(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and hash of each token; ``starts`` are the first bytes of the texts."""
        size = len(data)
        edge = np.zeros(size + 1, dtype=bool)
        edge[starts] = True
        edge[size] = True
        word = _IS_WORD[data]
        first = word & (edge[:-1] | ~np.r_[False, word[:-1]])
        last = word & (edge[1:] | ~np.r_[word[1:], False])
        length = _LENGTH[data]
        other = ~word & ~_IS_SPACE[data] & (length > 0)
        wide = np.flatnonzero(length > 1)
        if len(wide):
            padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64)
            k = length[wide]
            two = (padded[wide] & 31) << 6 | padded[wide + 1] & 63
            three = (padded[wide] & 15) << 12 | (padded[wide + 1] & 63) << 6 | padded[wide + 2] & 63
            point = np.where(k == 2, two, np.where(k == 3, three, 0))
            other[wide[np.isin(point, _WIDE_SPACES)]] = False
        at = np.flatnonzero(first | other)
        end = at + length[at]
        end[first[at]] = np.flatnonzero(last) + 1
        if len(self._up) < size + 1:
            self._up, self._down = _powers(_STEP, size + 1), _powers(_BACK, size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:size], out=sums[1:])
        h = (sums[end] - sums[at]) * self._down[at] + (end - at).astype(np.uint64) * _MIX
        h ^= h >> np.uint64(31)
        return at, h * _MIX

    def of(self, sources: pa.ListArray) -> list[np.ndarray]:
        """For each row the sorted distinct n-grams within any one of its texts."""
        sizes = np.r_[0, np.cumsum(_dense(pc.fill_null(pc.list_value_length(sources), 0)))]
        texts = pc.fill_null(pc.list_flatten(sources).cast(pa.large_string()), "")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = offsets[sizes]
        out: list[np.ndarray] = []
        row = 0
        while row < len(sources):
            upto = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, side="right")) - 1)
            out += self._rows(data, offsets, sizes[row : upto + 1])
            row = upto
        return out

    def _rows(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        low, high = offsets[sizes[0]], offsets[sizes[-1]]
        begin = offsets[sizes[0] : sizes[-1]] - low
        at, h = self.tokens(data[low:high], begin)
        rows = len(sizes) - 1
        if len(h) < self.n:
            return [np.zeros(0, dtype=np.uint64)] * rows
        # empty texts share their first byte with the next one, which then owns it
        text = np.searchsorted(begin, at, side="right") - 1
        size = len(h) - self.n + 1
        g = np.zeros(size, dtype=np.uint64)
        for i, f in enumerate(self._factors):
            g += h[i : i + size] * f
        g ^= g >> np.uint64(29)
        g *= _MIX
        g ^= g >> np.uint64(32)
        within = text[:size] == text[self.n - 1 :]
        g, owner = g[within], np.searchsorted(sizes, text[:size][within] + sizes[0], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(rows + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            g[a:b].sort()
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        upto = np.r_[0, np.cumsum(new)][cuts]
        g = g[new]
        return [g[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


def _dense(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False) if isinstance(a, pa.Array) else a.to_numpy()


def set_key(grams: np.ndarray) -> int:
    """One number for a whole set, equal for equal sets."""
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_SETS = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("ranges", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def _scan(df: DataFrame, n: int) -> DataFrame:
    """id, class, size of each record's set, and the set itself once a class and task; then slices of the task's sketch.

    ``df`` holds id and sources.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        grams, sent = GramSets(n), set()
        for batch in batches:
            sets = grams.of(batch.column(1))
            there = [i for i, s in enumerate(sets) if len(s)]
            if not there:
                continue
            np.add.at(sketch, _bucket(np.concatenate([sets[i] for i in there])), 1)
            keys, held, ranges = [set_key(sets[i]) for i in there], [], []
            for i, key in zip(there, keys, strict=True):
                new = key not in sent
                if new:
                    if len(sent) >= MAX_SENT:
                        sent.clear()
                    sent.add(key)
                held.append(sets[i].tobytes() if new else None)
                ranges.append(range_counts(sets[i]).tobytes() if new else None)
            none = lambda t, k=len(there): pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(there, pa.int64())), pa.array(keys, pa.int64()), pa.array([len(sets[i]) for i in there], pa.int32()), pa.array(held, pa.binary()), pa.array(ranges, pa.binary()), none(pa.int32()), none(pa.binary())],
                schema=_SETS,
            )
        packed = [(k, zstandard.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(sketch, SLICES)) if part.any()]
        none = [pa.nulls(len(packed), f.type) for f in list(_SETS)[:5]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in packed], pa.int32()), pa.array([c for _, c in packed], pa.binary())], schema=_SETS)

    return df.mapInArrow(scan, "id long, cls long, n int, grams binary, ranges binary, slice int, counts binary")


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The merged sketch as codes of the counts, one byte each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(counts), np.int32)
                open_[k] = open_[k] + part if k in open_ else part.astype(np.int64)
        codes = [np.where(c > 0, np.minimum(255, 1 + np.rint(CODE * np.log2(np.maximum(c, 1)))), 0).astype(np.uint8) for c in open_.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(open_), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["slice", "codes"])

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.uint8)
    for r in scanned.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, codes binary").collect():
        out[r.slice] = np.frombuffer(r.codes, np.uint8)
    return out.reshape(-1)


# an entry's size, position and role share one long, in this order of bits, so that sorting by it sorts by size
_POS_BITS = 31


def _entries(sets: DataFrame, num: int, den: int, sketch) -> DataFrame:  # noqa: ANN001
    """The prefix grams of each set: gram (salted if hot), what (size, position, visitor), cls.

    A hot gram's entry has one salt as its home and visits all others; a pair
    meets where its smaller set is at home.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = sketch.value
        times = np.where(np.arange(256) > 0, 2.0 ** ((np.arange(256) - 1) / CODE), 0)
        mean = float((np.bincount(codes, minlength=256) * times).sum() / len(codes))
        salts = 1 + (np.maximum(times - 4 * mean, 0) / HOT).astype(np.int64)
        for batch in batches:
            grams, whats, classes = [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                n = len(s)
                length = min(n, n - -(-num * n // den) + SHARED)
                code = codes[_bucket(s)]
                # the sets are sorted, so a stable order by code is one by code and gram
                first = np.argsort(code, kind="stable")[:length]
                g, k = s[first], salts[code[first]]
                what = np.int64(n) << (_POS_BITS + 1) | np.arange(length, dtype=np.int64) << 1
                if (hot := np.flatnonzero(k > 1)).size:
                    home = key % k[hot]
                    salt = np.concatenate([np.delete(np.arange(x), h) for x, h in zip(k[hot], home, strict=True)])
                    again = np.repeat(hot, k[hot] - 1)
                    visit = _salted(g[again], salt)
                    g = g.copy()
                    g[hot] = _salted(g[hot], home)
                    g, what = np.r_[g, visit], np.r_[what, what[again] | 1]
                grams.append(g.view(np.int64))
                whats.append(what)
                classes.append(np.full(len(g), key, np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, whats, classes)], names=["gram", "what", "cls"])

    return sets.select("cls", "grams").mapInArrow(prefixes, "gram long, what long, cls long")


def _salted(grams: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (grams ^ (salt.astype(np.uint64) + np.uint64(1)) * _STEP) * _MIX


def meetings(gram: np.ndarray, what: np.ndarray, cls: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of classes that pass the filters, from whole runs of entries sorted by gram, what and cls.

    Gives the smaller set, the larger one, and the number of prefix grams that they must share.
    """
    if not len(gram):
        return
    # copies of a class that came from several tasks
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (what[1:] != what[:-1]) | (cls[1:] != cls[:-1])
    gram, what, cls = gram[new], what[new], cls[new]
    run = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
    alone = np.bincount(run) == 1
    many = ~alone[run]
    run, what, cls = run[many].astype(np.int64), what[many], cls[many]
    n, pos, visitor = what >> (_POS_BITS + 1), (what >> 1) & ((1 << _POS_BITS) - 1), what & 1
    # an entry's partners are the later ones of its run up to the largest size that the length filter allows
    limit = n * den // num
    order = run << np.int64(32) | n
    upto = np.searchsorted(order, run << np.int64(32) | np.minimum(limit, (1 << 32) - 1), side="right")
    times = upto - np.arange(len(n)) - 1
    done = np.cumsum(times)
    short = pos < n - -(-2 * num * n // (num + den)) + SHARED
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
        a = np.repeat(np.arange(at, end), times[at:end])
        b = np.arange(len(a)) - np.repeat(np.r_[0, np.cumsum(times[at:end])[:-1]], times[at:end]) + a + 1
        swap = (n[a] == n[b]) & (cls[b] < cls[a])
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        keep = (visitor[a] == 0) & short[a] & (cls[a] != cls[b])
        a, b = a[keep], b[keep]
        needed = -(-num * (n[a] + n[b]) // (num + den))
        least = np.minimum(needed, SHARED)
        keep = np.minimum(n[a] - pos[a], n[b] - pos[b]) > needed - least
        yield cls[a[keep]], cls[b[keep]], least[keep]
        at = end


def _candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes (the smaller set first) that share enough prefix grams and pass the filters."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b, least in meetings(*columns, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(least.astype(np.int32))], names=["cls_a", "cls_b", "least"])

        for batch in batches:
            got = [np.concatenate([r, _dense(c)]) for r, c in zip(rest, batch.columns, strict=True)]
            # the last gram may go on in the next batch
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            yield from out([g[:cut] for g in got])
            rest = [g[cut:] for g in got]
        yield from out(rest)

    met = entries.repartition("gram").sortWithinPartitions("gram", "what", "cls").mapInArrow(pairs, "cls_a long, cls_b long, least int")
    return met.groupBy("cls_a", "cls_b").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least")).where("shared >= least").select("cls_a", "cls_b")


def range_counts(grams: np.ndarray) -> np.ndarray:
    """How many grams lie in each of SUFFIX_RANGES equal ranges of the gram space, 255 at most."""
    edges = np.arange(1, SUFFIX_RANGES, dtype=np.uint64) * np.uint64(2**64 // SUFFIX_RANGES)
    return np.minimum(255, np.diff(np.r_[0, np.searchsorted(grams, edges), len(grams)])).astype(np.uint8)


def suffix_bound(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most so many grams can be common, by both sizes' sums and the range counts (one row a pair)."""
    return (n - np.abs(x.astype(np.int64) - y.astype(np.int64)).sum(axis=1)) // 2


def _suffix_filtered(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the range counts of their sets leave open."""
    asked = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    held = sets.select("cls", "n", "ranges").join(small_or_plain(asked, MAX_BROADCAST_MEMBERS), "cls", "left_semi").dropDuplicates(["cls"])
    held = small_or_plain(write_table(held, "ranges"), MAX_BROADCAST_MEMBERS)
    both = pairs.join(held.toDF("cls_a", "n_a", "x"), "cls_a").join(held.toDF("cls_b", "n_b", "y"), "cls_b").select("cls_a", "cls_b", F.expr("n_a + n_b").cast("bigint").alias("n"), "x", "y")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = _dense(batch.column(2))
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SUFFIX_RANGES) for i in (3, 4))
                yield batch.select([0, 1]).filter(pa.array(suffix_bound(n, x, y) >= -(-num * n // (num + den))))

    return both.mapInArrow(bounded, "cls_a long, cls_b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are alike, each looked at once."""
    asked = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    one = sets.select("cls", "grams").join(small_or_plain(asked, MAX_BROADCAST_MEMBERS), "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams"))
    smaller = one.toDF("cls_a", "x").join(small_or_plain(pairs, MAX_BROADCAST_MEMBERS), "cls_a")
    both = smaller.join(one.toDF("cls_b", "y").hint("merge"), "cls_b").select("cls_a", "cls_b", "x", "y")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append((num + den) * len(np.intersect1d(a, b, assume_unique=True)) >= num * (len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(alike, "cls_a long, cls_b long")


def near_duplicates(df: DataFrame, key: str, sources: Column, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Alike classes of records with a Jaccard similarity of at least num / den of their n-gram sets.

    ``key`` is an integer id, ``sources`` an array of texts. Returns the pairs
    (cls_a, cls_b) of different classes and the members (id, cls, n) of all.
    """
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), sources.alias("sources"))
    scanned = write_table(_scan(texts, n), "sets")
    members = scanned.where("id is not null").select("id", "cls", "n")
    sets = scanned.where("grams is not null").select("cls", "n", "grams", "ranges")
    sketch = df.sparkSession.sparkContext.broadcast(_sketch(scanned))
    pairs = write_table(_candidates(_entries(sets, num, den, sketch), num, den), "candidates")
    pairs = write_table(_suffix_filtered(pairs, sets, num, den), "candidates")
    return _verified(pairs, sets, num, den), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records (a < b): those within a class, and those of alike classes.

    A class of many copies is cut into blocks, so that no task pairs all of them.
    """
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("_k"))
    blocks = F.ceil(F.col("_k") / BLOCK_COPIES)
    placed = members.join(copies, "cls").select("id", "cls", F.pmod(F.xxhash64("id"), blocks).alias("_b"))
    links = pairs.select("cls_a", "cls_b").unionByName(copies.where("_k > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    for side in ("a", "b"):
        each = copies.select(F.col("cls").alias(f"cls_{side}"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias(f"_{side}"))
        links = links.join(each, f"cls_{side}")
    x, y = placed.toDF("p", "cls_a", "_a"), placed.toDF("q", "cls_b", "_b")
    met = links.join(x, ["cls_a", "_a"]).join(y, ["cls_b", "_b"]).where("cls_a <> cls_b or p < q")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record with a set: id, cls and the number of records it is alike to."""
    size = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(pairs.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    others = ends.join(size.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("copies").alias("others"))
    return members.join(size, "cls").join(others, "cls", "left").select("id", "cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
