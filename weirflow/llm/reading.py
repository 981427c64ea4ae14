"""How demanding a text is, by unfamiliar words and sentence length.

A familiar-word formula: the share of a text's words outside a list of familiar
words, plus the average sentence length. The list is not a fixed one: a word is
familiar if it occurs in a given share of the corpus' texts, counted over all of
them. At most (mean distinct words per text) / SHARES[0] words can be so,
whatever the corpus, so the list has a proven size and is broadcast.

The two features are weighted by a logistic fit to graded texts (hard or not), on
at most MAX_LABELS labels. Its prior are the published weights of Dale and Chall
(1948), so there is no number of labels from which another formula holds: without
labels it is theirs, with many the labels decide. Graders err, so labels that
contradict a fit strongly are set aside and the fit is repeated. The share from
which on a word is familiar is learned too: that of SHARES whose fits predict
held-out labels best (of those within a standard error, the one next to
DEFAULT_SHARE, which also holds without labels).

Prose is what remains without fenced code, headings, table rows and lines that
are only a link; marks of lists and quotes, inline code and text in brackets
are dropped. A sentence ends at a mark before white space, at the end of a
paragraph or list item.

Defined cases: null, empty and blank texts, and texts without prose, have no
words, no sentences and no level (null); labels of unknown texts, without a
band, or given twice by one grader for one text count once or not at all; an
empty table gives no rows. Texts are read as a whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import write_table

#: Shares of texts from which on a word may count as familiar.
SHARES = (0.025, 0.04, 0.06, 0.09, 0.13, 0.2, 0.3, 0.45)
DEFAULT_SHARE = 0.1
#: Labels used for the fit, at most: those with the least hash of their id.
MAX_LABELS = 20_000
HARD_BAND = 3
#: Dale and Chall's weights of the share of unfamiliar words, of words per sentence, and the constant (fixed values), less the
#: score from which on a text asks for college; and the logits that one point of their score is taken for.
DALE_CHALL = (15.79, 0.0496, 3.6365 - 9.0)
LOGITS_PER_POINT = 4.0
#: Weight of the prior against one label, by feature.
RIDGE = (0.02, 0.02, 1e-4)
FOLDS = 5

_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_LINK_LINE = re.compile(r"(?:<?(?:https?|ftp)://\S+>?|!?\[[^\]]*\]\([^)]*\)|!?\[[^\]]*\]:?\s*\S*://\S+)[.,;]?")
_MARK = re.compile(r"(?:[-*+•]|\d{1,3}[.)])[ \t]+")
_RULE = re.compile(r"[-=*_ ]{3,}")
_DROP = re.compile(r"`[^`\n]*`|\([^()\n]*\)|https?://\S+|<[^<>\n]{1,200}>")
_SHORT = re.compile(r"\b(?:e\.g|i\.e|etc|cf|vs|approx)\.", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?…]+(?=[\s\"'”’)\]*_]|$)|\n")


def prose(text: str) -> list[str]:
    """The paragraphs and list items of a text's prose."""
    out: list[str] = []
    open_: list[str] = []
    fence = ""

    def close() -> None:
        if open_:
            out.append(" ".join(open_))
            open_.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = ""
            continue
        s = line.strip()
        while s.startswith(">"):
            s = s[1:].lstrip()
        if mark:
            fence = mark[1][:3]
            close()
        elif not s or s[0] in "#|" or _RULE.fullmatch(s):
            close()
        else:
            item = _MARK.match(s)
            if item:
                close()
                s = s[item.end() :]
            if _LINK_LINE.fullmatch(s):
                close()
            elif s:
                if open_ and s[0].isupper() and open_[-1][-1:] not in ",;:-":
                    close()
                open_.append(s)
    close()
    return out


def measure(text: str | None) -> tuple[Counter, int]:
    """The words of a text's prose in lower case, with their counts, and its number of sentences."""
    words: Counter = Counter()
    sentences = 0
    body = "\n".join(prose(text)) if text else ""
    if body:
        body = _SHORT.sub(" ", _DROP.sub(" ", body))
        for part in _END.split(body):
            found = _WORD.findall(part)
            if found:
                sentences += 1
                words.update(w.lower() for w in found)
    return words, sentences


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_words, n_sentences and the distinct words with their counts, for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, words, times, totals, sentences = [0], [], [], [], []
            for t in batch.column(1):
                w, n = measure(t.as_py())
                words.extend(w)
                times.extend(w.values())
                ends.append(len(words))
                totals.append(sum(w.values()))
                sentences.append(n)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(sentences, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=[key, "n_words", "n_sentences", "words", "times"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(count, f"`{key}` {kind}, n_words bigint, n_sentences bigint, words array<string>, times array<int>")


def familiar_words(counted: DataFrame, min_share: float = SHARES[0]) -> dict[str, float]:
    """The words of at least ``min_share`` of all texts with words, and their shares."""
    texts = counted.where("n_words > 0").count()
    rows = counted.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_share * texts)
    return {r.w: r.n / texts for r in rows.collect()} if texts else {}


def unfamiliar(counted: DataFrame, key: str, familiar: dict[str, float], shares: tuple[float, ...]) -> DataFrame:
    """key, n_words, n_sentences and, per share, how many of the words are not familiar by it."""
    words = sorted(familiar)
    level = np.array([sum(familiar[w] >= s for s in shares) for w in words] + [0], dtype=np.int64)
    shared = counted.sparkSession.sparkContext.broadcast((words, level))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = pa.array(shared.value[0], pa.string()), shared.value[1]
        for batch in batches:
            words, times = batch.column(3), pc.list_flatten(batch.column(4)).to_numpy(zero_copy_only=False)
            at = level[pc.fill_null(pc.index_in(pc.list_flatten(words), known), -1).to_numpy(zero_copy_only=False)]
            ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
            begins = np.r_[0, ends[:-1]] if len(ends) else ends
            counts = np.zeros((len(ends), len(shares)), dtype=np.int64)
            for i in range(len(shares)):
                upto = np.r_[0, np.cumsum(np.where(at > i, 0, times))]
                counts[:, i] = upto[ends] - upto[begins]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * len(shares), pa.int32()), pa.array(counts.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=[key, "n_words", "n_sentences", "n_unfamiliar"])

    kind = counted.schema[key].dataType.simpleString()
    return counted.select(key, "n_words", "n_sentences", "words", "times").mapInArrow(outside, f"`{key}` {kind}, n_words bigint, n_sentences bigint, n_unfamiliar array<bigint>")


_SCALE = np.array([0.1, 10.0, 1.0])


def _logistic(x: np.ndarray, hard: np.ndarray, prior: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The most likely weights under the prior: Newton's steps, each halved until it helps."""
    ridge = np.diag(RIDGE)

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - hard * z).sum() + (w - prior) @ ridge @ (w - prior) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        down = x.T @ (p - hard) + ridge @ (w - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, down)
        size, now = 1.0, cost(w)
        while size > 1e-6 and cost(w - size * step) > now - 1e-4 * size * float(down @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit_hard(unfamiliar: np.ndarray, length: np.ndarray, hard: np.ndarray, rounds: int = 8) -> tuple[float, float, float]:
    """Weights of a logistic formula for hard texts, robust against a minority of wrong labels."""
    x = np.c_[unfamiliar, length, np.ones(len(hard))] / _SCALE
    prior = np.array(DALE_CHALL) * LOGITS_PER_POINT * _SCALE
    keep = np.ones(len(hard), dtype=bool)
    w = np.zeros(3)
    for _ in range(rounds):
        w = _logistic(x[keep], hard[keep].astype(float), prior, w)
        now = np.abs(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - hard) < 0.8
        if (now == keep).all():
            break
        keep = now
    return tuple(float(v) for v in w / _SCALE)


def learn(unfamiliar: np.ndarray, length: np.ndarray, hard: np.ndarray, shares: tuple[float, ...]) -> tuple[float, tuple[float, float, float]]:
    """The share by which words are familiar and the formula's weights; ``unfamiliar`` has a column per share."""
    n = len(hard)
    fold = np.arange(n) % FOLDS
    loss = np.zeros((len(shares), n))
    for i in range(len(shares)):
        for k in range(min(FOLDS, n)):
            out = fold == k
            a, b, c = fit_hard(unfamiliar[~out, i], length[~out], hard[~out])
            sure = np.where(hard[out], 1, -1) * (a * unfamiliar[out, i] + b * length[out] + c)
            # a wrong label costs no more than a few logits
            loss[i, out] = np.minimum(np.log1p(np.exp(-np.clip(sure, -30, 30))), 3)
    mean = loss.mean(axis=1) if n else np.zeros(len(shares))
    i = min(range(len(shares)), key=lambda i: (mean[i], abs(np.log(shares[i] / DEFAULT_SHARE))))
    return shares[i], fit_hard(unfamiliar[:, i], length, hard)


def calibrate(counted: DataFrame, key: str, familiar: dict[str, float], labels: DataFrame, label_id: str, grader: str, band: str) -> tuple[float, tuple[float, float, float]]:
    """What graded texts say: the share of familiar words and the formula's weights."""
    given = labels.where(F.col(band).isNotNull() & F.col(key).isNotNull()).groupBy(key, grader).agg(F.max(F.struct(label_id, band)).alias("_l"))
    sample = write_table(given.select(key, F.col(f"_l.{band}").alias("_band"), F.xxhash64(f"_l.{label_id}").alias("_h")).orderBy("_h", key).limit(MAX_LABELS), "labels")
    graded = counted.where("n_words > 0").join(F.broadcast(sample.select(key).distinct()), key, "left_semi")
    rows = unfamiliar(graded, key, familiar, SHARES).join(F.broadcast(sample), key).select("_h", key, "n_words", "n_sentences", "n_unfamiliar", "_band").collect()
    rows.sort(key=lambda r: (r._h, repr(r[key])))
    words = np.array([r.n_words for r in rows], dtype=float)
    shares = np.array([r.n_unfamiliar for r in rows], dtype=float).reshape(len(rows), len(SHARES)) / words[:, None]
    return learn(shares, words / np.array([r.n_sentences for r in rows], dtype=float), np.array([r._band >= HARD_BAND for r in rows], dtype=bool), SHARES)


def reading_levels(docs: DataFrame, key: str, text: str, labels: DataFrame, label_id: str = "label_id", grader: str = "grader", band: str = "band") -> DataFrame:
    """key, n_words, n_sentences, unfamiliar, words_per_sentence and ``level`` (above 0: hard) for every row."""
    counted = write_table(features(docs, key, text), "words")
    familiar = familiar_words(counted)
    share, (a, b, c) = calibrate(counted, key, familiar, labels, label_id, grader, band)
    rows = unfamiliar(counted, key, {w: s for w, s in familiar.items() if s >= share}, (share,))
    shares = rows.select(key, "n_words", "n_sentences", F.try_divide(F.col("n_unfamiliar")[0], F.col("n_words")).alias("unfamiliar"), F.try_divide("n_words", "n_sentences").alias("words_per_sentence"))
    return shares.withColumn("level", F.round(F.lit(a) * F.col("unfamiliar") + F.lit(b) * F.col("words_per_sentence") + F.lit(c), 6))
