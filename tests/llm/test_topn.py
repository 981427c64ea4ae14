from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weirflow.llm import topn
from weirflow.storage import write_table


def brute(data, n):
    out = []
    for g in {r[0] for r in data}:
        part = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2].encode(), r[3]))
        out += [(g, i + 1, r[3]) for i, r in enumerate(part[:n])]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_against_brute_force(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(topn, "MAX_BROADCAST_GROUPS", broadcast)
    random.seed(3)
    data = [(random.choice(["hot", "hot", "hot", "b", "c"]), random.choice([5, 5, 5, 7, 10**9, 2**63 - 2, random.randrange(1000)]), random.choice(["f", "é", "zz", "Z"]), i) for i in range(2000)] + [("one", 1, "x", 9999)]
    df = write_table(spark.createDataFrame(data, "g string, s bigint, f string, id int"), "topn")
    assert rows(topn.top_n(df, "g", "s", [F.col("f"), F.col("id")], 5), "g", "rnk", "id") == brute(data, 5)


def test_all_tied_repeated_and_empty(spark, rows):
    df = write_table(spark.createDataFrame([("g", 4, "f", 1, 0, 9)] * 500 + [("h", 0, "f", 2, 0, 9), (None, 3, "f", 3, 0, 9)], "g string, s bigint, f string, id int, _least int, rnk int"), "topn")
    assert rows(topn.top_n(df, "g", "s", [F.col("f"), F.col("id")], 2), "g", "rnk", "id") == sorted([("g", 1, 1), ("g", 2, 1), ("h", 1, 2), (None, 1, 3)], key=repr)
    assert topn.top_n(df.limit(0), "g", "s", [F.col("f")], 2).count() == 0


def test_every_group_drops_rows_and_keeps_enough(spark):
    random.seed(4)
    df = write_table(spark.createDataFrame([(f"g{k}", random.randrange(10**6)) for k in range(40) for _ in range(k)], "g string, s bigint"), "topn")
    kept = {r.g: r["count"] for r in topn.survivors(df, "g", "s", 5).groupBy("g").count().collect()}
    assert all(kept[f"g{k}"] >= min(5, k) for k in range(1, 40)) and all(kept[f"g{k}"] < k for k in range(25, 40))
    plan = topn.top_n(df, "g", "s", [F.col("s")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
