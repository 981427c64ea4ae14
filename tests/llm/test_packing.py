from __future__ import annotations

import random

import numpy as np

from weirflow.llm.packing import best_fit, pack


def plain_best_fit(items, capacity):
    gaps: list[int] = []
    for s in sorted(items, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_as_good_as_best_fit_decreasing():
    random.seed(3)
    for t in range(200):
        capacity, n = random.choice([7, 20, 64, 100]), random.randint(1, 100)
        items = [random.randint(1, capacity) if t % 2 else random.choice([1, 2, 3, capacity // 2, capacity]) for _ in range(n)]
        sizes, counts = np.unique(items, return_counts=True)
        matches, opened = best_fit(sizes, counts, capacity)
        fill: dict[int, int] = {}
        for s, k in zip(sizes, counts, strict=True):
            m = matches[matches[:, 0] == s]
            for r in range(k):
                j = np.searchsorted(m[:, 1], r, side="right") - 1
                no = int(m[j, 3] + (r - m[j, 1]) // m[j, 2])
                fill[no] = fill.get(no, 0) + int(s)
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(opened)) and opened == plain_best_fit(items, capacity)


def test_the_number_of_matches_does_not_grow_with_the_items():
    sizes = np.arange(1, 513)
    few, many = (best_fit(sizes, np.full(512, n), 512) for n in (10, 10**9))
    assert len(many[0]) <= 3 * 512 * 9 and many[1] >= 10**9 * 256 and few[1] > 0


def check(spark, items, kinds):
    df = spark.createDataFrame(items, "doc_id bigint, n bigint, container string, size int")
    rows, usage = pack(df, "doc_id", "n", spark.createDataFrame(kinds, "container string, capacity int"))
    assert rows.columns == ["container", "container_no", "doc_id", "piece", "start", "size"]
    got = rows.collect()
    for u in usage:
        mine = [r for r in got if r.container == u["container"]]
        fill: dict[int, int] = {}
        parts: dict[int, list] = {}
        for r in mine:
            fill[r.container_no] = fill.get(r.container_no, 0) + r["size"]
            parts.setdefault(r.doc_id, []).append((r.piece, r.start, r["size"]))
        assert all(f <= u["capacity"] for f in fill.values()) and len(fill) == u["containers"]
        for doc, n, *_ in items:
            p = sorted(parts[doc])
            assert sum(x[2] for x in p) == max(n or 0, 0) and [x[1] for x in p] == [k * u["capacity"] for k in range(len(p))]
            assert len(p) == max(1, -(-max(n or 0, 0) // u["capacity"]))
        pieces = [x[2] for p in parts.values() for x in p if x[2]]
        assert u["containers"] == max(plain_best_fit(pieces, u["capacity"]), 1)
    return got


def test_items_of_all_sizes(spark):
    random.seed(8)
    items = [(i, random.choice([0, None, 3, 3, 3, 3, 100, random.randrange(1, 90), 1000]), "x", 1) for i in range(400)]
    check(spark, items, [("small", 32), ("wide", 256)])


def test_a_third_of_one_size_only_empty_and_none(spark):
    check(spark, [(i, 5, None, None) for i in range(300)] + [(1000 + i, i % 11, None, None) for i in range(600)], [("c", 10)])
    check(spark, [(1, 0, None, None), (2, None, None, None)], [("c", 10)])
    empty = spark.createDataFrame([], "doc_id bigint, n bigint")
    rows, usage = pack(empty, "doc_id", "n", spark.createDataFrame([("c", 10), ("bad", 0), (None, 5)], "container string, capacity int"))
    assert rows.count() == 0 and [u["containers"] for u in usage] == [0]
    rows, usage = pack(empty, "doc_id", "n", spark.createDataFrame([], "container string, capacity int"))
    assert rows.count() == 0 and usage == []
