from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import qdigest, timings


def exact(values, num, den):
    v = sorted(values)
    return v[max(1, -(-num * len(v) // den)) - 1]


def test_leaves_are_ordered_and_hold_their_values(spark):
    random.seed(1)
    vs = sorted({0, 1, 255, 256, 257, 511, 512, 2**53 - 1, 2**53, 2**53 + 1, 2**62, 2**63 - 2, *[2**k + d for k in range(9, 63) for d in (-1, 0, 1)], *[random.randrange(2**63 - 1) for _ in range(500)]})
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").select("v", qdigest.leaf(F.col("v")).alias("leaf"))
    got = [(r.v, r.leaf) for r in df.orderBy("v").collect()]
    leaves = [x for _, x in got]
    assert leaves == sorted(leaves) and max(leaves) < 2**qdigest.HEIGHT
    low, high = qdigest.leaf_range(np.array(leaves))
    assert all(a <= v <= b for (v, _), a, b in zip(got, low.tolist(), high.tolist(), strict=True))
    assert all(b - a <= max(a >> qdigest.MANTISSA, 0) for a, b in zip(low.tolist(), high.tolist(), strict=True))


@pytest.mark.parametrize("k", [4, 50])
def test_rank_error_is_bounded_and_merging_keeps_it(k):
    rng = np.random.default_rng(k)
    parts = [rng.integers(0, 14_000, n) for n in (1, 1000, 5000)] + [np.full(4000, 77)]
    folded = [qdigest.fold(p + 2**14, np.ones(len(p), dtype=np.int64), k) for p in parts]
    nodes, counts = qdigest.fold(np.concatenate([a for a, _ in folded]), np.concatenate([b for _, b in folded]), k)
    every = np.sort(np.concatenate(parts))
    n = len(every)
    assert counts.sum() == n and len(nodes) <= 3 * k + 3
    for q in (1, 25, 50, 95, 100):
        (low, high), = qdigest.bounds(nodes, counts, [(q, 100)])
        a, b = qdigest.leaf_range(np.array([exact(every.tolist(), q, 100)]))
        assert low <= a[0] and b[0] <= high
        rank = max(1, -(-q * n // 100))
        lows, _ = qdigest.leaf_range(every)
        assert rank - np.searchsorted(lows, low, side="left") <= qdigest.HEIGHT * (n // k) + n // k + (every == every[rank - 1]).sum()


def test_days_add_up_to_the_week(spark):
    random.seed(4)
    rows = [(random.choice("ab") if random.random() > 0.1 else None, d, int(random.expovariate(1 / 500)) + (10**12 if random.random() < 0.03 else 0)) for d in range(7) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, d int, v bigint").withColumn("node", F.lit("x")).withColumn("n", F.lit(1))
    q = {"p50": (50, 100), "p95": (95, 100)}
    week = qdigest.merge(qdigest.digests(df, ["g", "d", "node"], "v", 40), ["g", "node"], 40)
    at_once = {r.g: r for r in qdigest.quantile_bounds(qdigest.digests(df, ["g"], "v", 10**6), ["g"], q).collect()}
    ex = {r.g: r for r in qdigest.exact_quantiles(df, ["g"], "v", q).collect()}
    for r in qdigest.quantile_bounds(week, ["g", "node"], q).collect():
        vs = [v for g, _, v in rows if g == r.g]
        assert r.n_values == len(vs)
        for name, (a, b) in q.items():
            e = exact(vs, a, b)
            assert r[f"{name}_low"] <= e <= r[f"{name}_high"] and at_once[r.g][f"{name}_low"] <= e <= at_once[r.g][f"{name}_high"]
            assert ex[r.g][name] == e


def test_extremes_empty_and_ties(spark):
    df = spark.createDataFrame([("g", 2**63 - 2)] * 3 + [("z", 0)], "g string, v bigint")
    assert {tuple(r) for r in qdigest.exact_quantiles(df, ["g"], "v", {"m": (50, 100)}).collect()} == {("g", 2**63 - 2), ("z", 0)}
    assert qdigest.digests(df.limit(0), ["g"], "v").count() == 0
    assert qdigest.exact_quantiles(df.limit(0), ["g"], "v", {"m": (1, 2)}).count() == 0


def test_latest_delivery(spark, rows):
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, t(1), 5, "x"), (1, t(3), 6, "y"), (1, t(2), 7, "z"), (2, t(1), None, "x"), (2, t(1), 4, "x"), (None, t(1), 1, "n"), (None, t(1), 1, "n"), (3, None, 8, "q"), (3, t(1), 9, "r")], "id int, at timestamp, ms bigint, _held string")
    assert rows(timings.latest_delivery(df, "id", "at", ["ms", "_held"])) == sorted([(1, 6, "y"), (2, 4, "x"), (None, 1, "n"), (None, 1, "n"), (3, 9, "r")], key=repr)
    bad = spark.createDataFrame([(None,), (-1,), (2**63 - 1,), (0,)], "ms bigint")
    assert rows(bad.where(timings.valid_ms())) == [(0,)]
