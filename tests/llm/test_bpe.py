from __future__ import annotations

import os
import random

import pytest

from weirflow.llm import bpe
from weirflow.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def published():
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(bpe.read_file(VOCABULARY)), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.read_file(VOCABULARY))


def test_equals_the_published_encoding(encoder, published):
    random.seed(1)
    letters = "abcdefghij 's'll\t\n\r \x1c\x1d\x85\xa0　éßж中文🙂0129²½Ⅷ_-<|endoftext|>"
    texts = ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(5000)]
    texts += ["a" * 30_000, " " * 4_000, "ab" * 4_000, "\n" * 999, "中" * 2_000, "<|endoftext|>", "I'LL don't we'd", "=-" * 2_000, "antidisestablishmentarianism", "́x"]
    for t in texts:
        ids = list(encoder.ids(t))
        assert ids == published(t) and encoder.size(t) == len(ids)
        assert b"".join(encoder._encoder.token[i] for i in ids).decode() == t


def test_prefix_tokens_are_those_of_the_definition(encoder):
    random.seed(2)
    for _ in range(300):
        piece = "".join(random.choices("theraning ", k=random.randrange(1, 14)))
        assert encoder._encoder.encode(piece) == encoder._encoder.merged(piece.encode())


def test_every_row_has_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(bpe, "IDS_PER_BATCH", 3)
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, " "), (4, " "), (None, "x" * 50)], "doc_id bigint, text string")
    got = rows(bpe.encode_texts(df, "doc_id", "text", VOCABULARY))
    assert [r for r in got if r[0] in (1, 2, 3, 4)] == [(1, [31373, 995]), (2, []), (3, []), (4, [220]), (4, [220])] and len(got) == 6
    assert rows(bpe.count_tokens(df.where("doc_id < 4"), "doc_id", "text", VOCABULARY)) == [(1, 2), (2, 0), (3, 0)]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


def test_caches_are_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    encoder._ids.clear()
    list(encoder.ids(" ".join(f"w{i}q" for i in range(200))))
    assert len(encoder._ids) <= 10
