from __future__ import annotations

import random

import numpy as np
import pytest

from weirflow.llm import reading

MARKED = "# A heading\n\nWe see the log, e.g. `x.y()`. It is v2.13.2 (see above.) and good!\nIs it?\n\n```py\ncode. here.\n```\n\n| a | b |\n\n- one item\n- two items\n\n> quoted words here\n> go on.\n\nhttps://x.y/z\n[a link](http://q)\n\nLast one"


def test_prose_and_its_sentences():
    for text in (MARKED, MARKED.replace("\n", "\r\n"), MARKED.replace("\n", "\r")):
        words, sentences = reading.measure(text)
        assert sentences == 7 and words["code"] == words["heading"] == words["link"] == 0 and words["items"] == 1 and words["quoted"] == 1
    for text in (None, "", "  \n", "# only\n| a |", "```\nopen fence. never closed.", "123 456"):
        assert reading.measure(text) == ({}, 0)
    words, sentences = reading.measure("word " * 200_000)
    assert words["word"] == 200_000 and sentences == 1


def corpus(spark, n=300):
    random.seed(6)
    easy, hard = [f"w{chr(97 + i)}" for i in range(20)], [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows, truth = [], {}
    for i in range(n):
        truth[i] = i % 3 == 0
        length = 25 if truth[i] else 8
        share = 0.4 if truth[i] else 0.02
        rows.append((i, " ".join(" ".join(random.choice(hard) if random.random() < share else random.choice(easy) for _ in range(length)) + "." for _ in range(8)), "x"))
    labels = [(k, k, f"g{k % 4}", (3 if truth[k] else 1 + k % 2) if k % 13 else 1 + 2 * (not truth[k])) for k in range(0, n, 2)]
    labels += [(1000, None, "g", 3), (1001, 5, "g", None), (1002, 9999, "g", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, words string"), spark.createDataFrame(labels, "label_id bigint, doc_id bigint, grader string, band int"), truth


def test_held_out_texts_despite_wrong_labels(spark):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, "doc_id", "text", labels).collect()}
    held_out = [i for i in truth if i % 2]
    assert sum((got[i] > 0) == truth[i] for i in held_out) == len(held_out)


def test_odd_rows_and_few_labels(spark):
    docs, labels, _ = corpus(spark, 30)
    odd = spark.createDataFrame([(100, None, "x"), (101, "", "x"), (102, "```\nx", "x"), (103, "One.", None)], docs.schema)
    got = {r.doc_id: r for r in reading.reading_levels(docs.unionByName(odd), "doc_id", "text", labels.limit(3)).collect()}
    assert len(got) == 34 and [got[i].level for i in (100, 101, 102)] == [None] * 3 and got[103].n_words == 1
    assert reading.reading_levels(docs.limit(0), "doc_id", "text", labels).count() == 0
    assert reading.reading_levels(docs, "doc_id", "text", labels.limit(0)).count() == 30


def test_the_list_of_familiar_words_is_bounded(spark):
    docs, _, _ = corpus(spark)
    counted = reading.features(docs, "doc_id", "text")
    words = reading.familiar_words(counted)
    mean = counted.selectExpr("avg(size(words)) as m").first().m
    assert len(words) <= mean / reading.SHARES[0] and "wa" in words


@pytest.mark.parametrize("n", [0, 1, 8, 500, 6000])
def test_the_share_is_learned_and_few_labels_change_no_formula(n):
    """The list that tells the texts apart is chosen, whatever the number of labels; without any the published weights hold."""
    rng = np.random.default_rng(1)
    hard = np.arange(n) % 3 == 0
    good, length = np.where(hard, 0.4, 0.1) + rng.normal(0, 0.01, n), np.where(hard, 25, 12) + rng.normal(0, 3, n)
    columns = np.c_[np.full(n, 0.001), rng.random(n), good]
    share, w = reading.learn(columns, length, hard ^ (np.arange(n) % 17 == 5), (0.02, 0.1, 0.3))
    if n == 0:
        assert share == 0.1 and np.allclose(w, np.array(reading.DALE_CHALL) * reading.LOGITS_PER_POINT)
    if n >= 500:
        assert share == 0.3 and ((w[0] * good + w[1] * length + w[2] > 0) == hard).all()


def test_the_fit_sets_wrong_labels_aside():
    rng = np.random.default_rng(0)
    hard = rng.random(400) < 0.3
    share, length = np.where(hard, 0.3, 0.03) + rng.normal(0, 0.02, 400), np.where(hard, 28, 12) + rng.normal(0, 2, 400)
    given = hard ^ (rng.random(400) < 0.08)
    a, b, c = reading.fit_hard(share, length, given)
    assert ((a * share + b * length + c > 0) == hard).mean() > 0.99
