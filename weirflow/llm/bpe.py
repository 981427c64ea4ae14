"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the encoding has a unique last token, and two facts
find it: the tokens that end at a position are the matches of a suffix-linked
automaton over the vocabulary, and a token t can follow the encoding that ends
in token s just if merging the bytes of s and t alone gives [s, t] again (pair
compatibility). So one sweep stores the last token of every prefix, and the
back-pointers from the end give the ids. The time is linear in the piece
times the tokens that end at one position; no merge queue is kept, so pieces
of any length (long runs of one character, text without blanks) are as cheap
as others. Pieces and tested pairs are kept in bounded caches of the worker.

Defined cases: null and empty texts have no ids (an empty list); strings of
special tokens in a text are ordinary text; texts are never cut.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the pre-tokenizer's pattern (the Unicode property; fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The published pre-tokenizer pattern of the vocabulary, and the same for ASCII text.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Bounds of a worker's caches; a full cache is emptied.
MAX_PIECES = 400_000
MAX_PIECE_CHARS = 200
MAX_PAIRS = 1_000_000
#: Ids of one output batch, about.
IDS_PER_BATCH = 2_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixEncoder:
    """Encodes pieces with a byte-level BPE vocabulary given as ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._matches = ahocorasick.Automaton()
        for t, i in ranks.items():
            self._matches.add_word(t.decode("latin-1"), (i, len(t)))
        self._matches.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the best-ranked neighbours until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(ranked)
            if best == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stands_alone(self, t: int) -> bool:
        if t not in self._alone:
            self._alone[t] = self.merged(self.token[t]) == [t]
        return self._alone[t]

    def _can_follow(self, s: int, t: int) -> bool:
        pair = (s, t)
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self.merged(self.token[s] + self.token[t]) == [s, t]
        return known

    def encode(self, piece: str) -> list[int]:
        data = piece.encode()
        text = data.decode("latin-1")
        last = [-1] * len(data)
        for end, (t, size) in self._matches.iter(text):
            if last[end] >= 0:
                continue
            before = end - size
            if self._stands_alone(t) if before < 0 else last[before] >= 0 and self._can_follow(last[before], t):
                last[end] = t
        out = []
        at = len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]


class _Cache(dict):
    """piece -> its value, computed once while it is kept."""

    def __init__(self, compute: Callable[[str], object]) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, piece: str) -> object:
        value = self.compute(piece)
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = value
        return value


class TextEncoder:
    """Texts to ids or to their number; one instance per worker and vocabulary."""

    _shared: dict[int, TextEncoder] = {}

    def __init__(self, vocabulary: bytes) -> None:
        import re

        import regex

        self._encoder = PrefixEncoder(read_ranks(vocabulary))
        self._ascii = re.compile(ASCII_PIECES).findall
        self._any = regex.compile(PIECES).findall
        self._ids = _Cache(lambda p: tuple(self._encoder.encode(p)))
        self._sizes = _Cache(lambda p: len(self._ids[p]))

    @classmethod
    def of(cls, vocabulary: bytes) -> TextEncoder:
        key = hash(vocabulary)
        if key not in cls._shared:
            cls._shared.clear()
            cls._shared[key] = cls(vocabulary)
        return cls._shared[key]

    def pieces(self, text: str) -> list[str]:
        return self._ascii(text) if text.isascii() else self._any(text)

    def ids(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self._ids.__getitem__, self.pieces(text))) if text else iter(())

    def size(self, text: str | None) -> int:
        return sum(map(self._sizes.__getitem__, self.pieces(text))) if text else 0


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``key`` and the ids of ``text`` for every row, by the vocabulary file at ``vocabulary``.

    The file (under 1 MB for 50,000 tokens) is read on the driver and broadcast
    to the workers, which need no copy of their own.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))
    schema = T.StructType([df.schema[key], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            values, ends, first = array("i"), [0], 0
            for i in range(len(texts)):
                values.extend(encoder.ids(texts[i].as_py()))
                ends.append(len(values))
                if len(values) >= IDS_PER_BATCH or i == len(texts) - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32) if len(values) else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, i + 1 - first), lists], names=[key, ids])
                    values, ends, first = array("i"), [0], i + 1

    return df.select(key, F.col(text).cast("string")).mapInArrow(encode, schema)


def count_tokens(df: DataFrame, key: str | Sequence[str], text: str, vocabulary: str, n: str = "n_tokens") -> DataFrame:
    """The keys and the number of ids of ``text`` for every row."""
    keys = [key] if isinstance(key, str) else list(key)
    shared = df.sparkSession.sparkContext.broadcast(read_file(vocabulary))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(n, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(shared.value)
        for batch in batches:
            texts = batch.column(len(keys))
            sizes = pa.array([encoder.size(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], sizes], names=[*keys, n])

    return df.select(*keys, F.col(text).cast("string")).mapInArrow(count, schema)
