"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - z) with ordered thresholds t_0 < t_1 < ... and one shared z, the mean over a text's words of hashed weights: of the word, of its shape (runs of capitals, small letters, digits and each other sign), and of repeating the word before it. From it come the expected grade and the tail probability P(grade >= k) by which documents are selected.

Grades come from the labels: 0 poor, 1 sound but toxic, 2 sound and clean. A document is selected if P(grade >= 1) is at least SELECT.

The fit uses at most `labelled` labelled documents (those of least md5 of doc_id), a documented bound, over their whole texts; everything else runs over all rows.

Defined cases: null and empty texts have z = 0 and get what the thresholds give for it; null labels are ignored; of several labels of one doc_id the largest count; rows alike are scored alike; without labels of two grades nothing can be told apart, and every document has the one known grade (or 0) and is selected; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean
from .toxicity import labelled_sample

LABELLED, BUCKETS, MIN_DF, SELECT, EPOCHS = 4000, 1 << 18, 3, 0.5, 150
_CLASSES = bytes(ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
REPEAT = 0


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    #: Whether the labels had two grades to tell apart.
    tells: bool = True


def word_features(word: bytes) -> tuple[int, int]:
    """Buckets of the word and of its shape; bucket 0 is the repeat's."""
    shape = _RUN.sub(rb"\1", word.translate(_CLASSES))
    return 1 + xxhash.xxh3_64_intdigest(word) % (BUCKETS - 1), 1 + xxhash.xxh3_64_intdigest(b"\x00" + shape) % (BUCKETS - 1)


class Weights(dict):
    """word -> its part of z; a bounded memory of frequent words."""

    LIMIT = 300_000

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.LIMIT:
            self.clear()
        a, b = word_features(word)
        value = self[word] = float(self.weights[a]) + float(self.weights[b])
        return value


def text_score(text: bytes, memo: Weights) -> float:
    words = text.split()
    if not words:
        return 0.0
    same = sum(map(eq, words, islice(words, 1, None)))
    return (sum(map(memo.__getitem__, words)) + same * float(memo.weights[REPEAT])) / len(words)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def probabilities(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = k) per row."""
    upto = _sigmoid(thresholds[None] - z[:, None])
    return np.diff(np.concatenate([np.zeros((len(z), 1)), upto, np.ones((len(z), 1))], axis=1), axis=1)


def fit(texts: list[str], grades: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Thresholds are a first one and log steps, so that they stay in order. With one grade only there are no thresholds."""
    grades = np.asarray(grades, int)
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.full(top, -40.0) + np.arange(top) * 1e-3, False)
    index: dict[bytes, int] = {}
    docs, sizes, same = [], [], []
    for t in texts:
        words = t.encode().split()
        docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        sizes.append(max(len(words), 1))
        same.append(sum(map(eq, words, islice(words, 1, None))))
    pairs = np.array([word_features(w) for w in index], np.int64).reshape(-1, 2)
    row, col, val = [], [], []
    for i, (d, n) in enumerate(zip(docs, sizes, strict=True)):
        f, c = np.unique(np.append(pairs[d].ravel(), np.full(same[i], REPEAT)), return_counts=True)
        row.append(np.full(len(f), i))
        col.append(f)
        val.append(c / n)
    row, col, val = np.concatenate(row), np.concatenate(col), np.concatenate(val)
    known = np.bincount(col, minlength=BUCKETS) >= MIN_DF
    live = known[col]
    row, col, val = row[live], col[live], val[live]
    used, local = np.unique(col, return_inverse=True)
    n = len(docs)
    order = np.argsort(local, kind="stable")
    at = np.searchsorted(local[order], np.arange(len(used)))
    # start from the thresholds of the grades' shares
    share = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    t0 = np.log(share / (1 - share))
    theta = np.concatenate([[t0[0]], np.log(np.maximum(np.diff(t0), 1e-3))])
    w = np.zeros(len(used))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, theta)]
    for step in range(1, epochs + 1):
        z = np.bincount(row, val * w[local], n)
        steps = np.exp(theta[1:])
        t = theta[0] + np.concatenate([[0], np.cumsum(steps)])
        upto = np.concatenate([np.zeros((n, 1)), _sigmoid(t[None] - z[:, None]), np.ones((n, 1))], axis=1)
        density = upto * (1 - upto)
        i = np.arange(n)
        p = np.maximum(upto[i, grades + 1] - upto[i, grades], 1e-9)
        hi, lo = density[i, grades + 1] / p, density[i, grades] / p
        dz = (hi - lo) / n  # of minus the log likelihood
        dt = np.array([(lo[grades == k + 1].sum() - hi[grades == k].sum()) / n for k in range(top)])
        dtheta = np.concatenate([[dt.sum()], [dt[k:].sum() * steps[k - 1] for k in range(1, top)]])
        dw = np.add.reduceat((val * dz[row])[order], at) + 1e-6 * w
        for k, (x, g, rate) in enumerate(((w, dw, 0.3), (theta, dtheta, 0.05))):
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))]))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    sample = labelled_sample(docs, labels, ["quality", "toxic"], labelled)
    good = (sample["quality"] > 0).to_numpy()
    return fit(sample["text"].tolist(), np.where(good, np.where(sample["toxic"] > 0, 1, 2), 0))


def score(model: Model, text: Column) -> Column:
    weights = model.weights

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Weights(weights)

        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([text_score((t or "").encode(), memo) for t in part], dtype="float64")

        yield from lean(scores)(parts)

    return run(text)


def _graded(model: Model, docs: DataFrame) -> DataFrame:
    z = docs.select("doc_id", score(model, F.coalesce(F.col("text"), F.lit(""))).alias("z"))
    tails = [1 / (1 + F.exp(F.lit(float(t)) - F.col("z"))) for t in model.thresholds]
    tails += [F.lit(0.0)] * (2 - len(tails))
    expected = tails[0]
    for t in tails[1:]:
        expected = expected + t
    return z.select("doc_id", expected.alias("expected_grade"), tails[0].alias("p_sound"), tails[1].alias("p_clean"))


def graded(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, expected_grade, p_sound = P(grade >= 1), p_clean = P(grade >= 2) of every document."""
    return _graded(train(docs, labels, labelled), docs)


def select_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, least: float = SELECT) -> DataFrame:
    """The documents that are selected, with their grades and selected = true."""
    model = train(docs, labels, labelled)
    chosen = F.col("p_sound") >= least if model.tells else F.lit(True)
    return _graded(model, docs).where(chosen).withColumn("selected", F.lit(True))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return select_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
