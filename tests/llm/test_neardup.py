from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import neardup
from weirflow.llm.neardup import GramSets

TOKENS = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]").findall


def grams(sources, n=3):
    out = set()
    for s in sources or []:
        t = TOKENS(s) if s else []
        out |= {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    return out


@pytest.mark.parametrize("chunk", [40, 1_500_000])
def test_gram_sets_equal_those_of_a_plain_tokenizer(monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK_BYTES", chunk)
    random.seed(2)
    letters = "ab_9 \t\n\r\x1c\x85\xa0　éß中🙂+-=()."
    rows = [random.choice([None, [], [None], [""]]) if random.random() < 0.1 else [random.choice([None, ""]) if random.random() < 0.2 else "".join(random.choices(letters, k=random.randrange(30))) for _ in range(random.randrange(4))] for _ in range(600)]
    got, want = GramSets(3).of(pa.array(rows, pa.list_(pa.string()))), [grams(r) for r in rows]
    assert [len(g) for g in got] == [len(w) for w in want]
    for _ in range(2000):
        i, j = random.randrange(600), random.randrange(600)
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def families():
    random.seed(7)
    word = lambda: random.choice("abcdefgh") + str(random.randrange(30))
    base = [[word() for _ in range(random.choice([6, 40, 120]))] for _ in range(8)]
    out = []
    for i in range(70):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 3, 12])):
            k = random.randrange(len(w))
            w[k : k + random.randrange(2)] = [word()] * random.randrange(3)
        out.append((i, [" ".join(w)], None if i % 3 else [None, ""]))
    out += [(100 + i, ["same same same but other"], None) for i in range(9)] + [(200, None, None), (201, [], [None]), (202, ["  "], []), (203, ["a b"], None), (None, ["same same same but other"], None), (300, None, ["same same same but other"])]
    return out


@pytest.mark.parametrize("hot", [4_000, 5])
def test_pairs_and_links_against_brute_force(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    data = families()
    df = spark.createDataFrame(data, "id bigint, p array<string>, n array<string>")
    none = F.array().cast("array<string>")
    pairs, members = neardup.near_duplicates(df, "id", F.concat(F.coalesce("p", none), F.coalesce("n", none)), 3, 3, 5)
    sets = {i: grams((p or []) + (n or [])) for i, p, n in data if i is not None}
    sets = {i: s for i, s in sets.items() if s}
    want = sorted((a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]))
    assert sorted(rows(neardup.expand(pairs, members), "a", "b")) == want and len(want) > 100
    links = {i: 0 for i in sets}
    for a, b in want:
        links[a] += 1
        links[b] += 1
    assert dict(rows(neardup.links(pairs, members), "id", "n_links")) == links


@pytest.mark.parametrize("num, den", [(3, 5), (4, 5), (1, 2)])
def test_prefixes_and_filters_lose_no_pair_at_the_threshold(num, den):
    """Pairs that have just enough in common must meet, in whatever order the grams are."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        common = rng.choice(2**60, n, replace=False).astype(np.uint64)
        spare = n * (den - num) // num
        k = int(rng.integers(0, spare + 1))
        extra = np.setdiff1d(rng.integers(0, 2**60, spare).astype(np.uint64), common)
        a, b = np.sort(np.r_[common, extra[:k]]), np.sort(np.r_[common, extra[k:]])
        rank = {int(g): i for i, g in enumerate(rng.permutation(np.union1d(a, b)))}
        rows, cls = [], {}
        for key, s in ((7, a), (9, b)):
            cls[key] = len(s)
            ordered = sorted(map(int, s), key=rank.get)
            length = min(len(s), len(s) - -(-num * len(s) // den) + neardup.SHARED)
            rows += [(g, len(s) << 32 | i << 1, key) for i, g in enumerate(ordered[:length])]
        columns = [np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)]
        met = [(int(p), int(q), int(z)) for part in neardup.meetings(*columns, num, den) for p, q, z in zip(*part, strict=True)]
        assert len(met) >= met[0][2] and all(cls[p] <= cls[q] for p, q, _ in met)
        x, y = (neardup.range_counts(v)[None] for v in (a, b))
        assert neardup.suffix_bound(np.array([len(a) + len(b)]), x, y)[0] >= n


def test_runs_are_paired_in_blocks(monkeypatch):
    """Blocks, repeated entries and visitors change nothing of what is found."""
    rng = np.random.default_rng(2)
    rows = sorted({(int(rng.integers(5)), int(rng.integers(10, 14)) << 32 | int(rng.integers(3)) << 1, int(rng.integers(30))) for _ in range(300)})
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    got = lambda cs: sorted(tuple(map(int, r)) for part in neardup.meetings(*cs, 3, 5) for r in zip(*part, strict=True))
    want = got(columns)
    assert want == got([np.repeat(c, 3) for c in columns])
    monkeypatch.setattr(neardup, "BLOCK_PAIRS", 7)
    assert want == got(columns) and len(want) > 100


def test_many_copies_are_expanded_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_COPIES", 3)
    members = spark.createDataFrame([(i, i % 2, 5) for i in range(20)] + [(50, 2, 5)], "id bigint, cls bigint, n int")
    pairs = spark.createDataFrame([(0, 2)], "cls_a bigint, cls_b bigint")
    want = [(a, b) for a in range(20) for b in range(a + 1, 20) if (a - b) % 2 == 0] + [(a, 50) for a in range(0, 20, 2)]
    assert rows(neardup.expand(pairs, members), "a", "b") == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, sources array<string>, cls int")
    pairs, members = neardup.near_duplicates(df, "id", F.col("sources"), 3, 3, 5)
    assert pairs.count() == 0 and members.count() == 0
