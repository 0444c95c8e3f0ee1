"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, lower-cased (a word repeated at once counts once); its vector is the mean of the embeddings of its character n-grams and of itself (all hashed), so a misspelling that was never seen shares most n-grams with the spelling that was. A window of WINDOW neighbouring words is the mean of its words' vectors, a linear softmax classifies it, and a document is as toxic as its most toxic window: a few words are enough in a text of any length, and every word of every text is read.

Labels say which documents are toxic, not where, so training alternates: each document is represented by its most toxic windows under the present model (at first, under n-gram log odds), embeddings and softmax are fitted together on those windows, and so on. Embeddings start at the n-grams' smoothed log odds in one dimension and at random in the others. Features seen in fewer than MIN_DF documents are left out. The threshold is the one of best F1 on labelled documents kept out of the fit.

The fit uses at most `labelled` labelled documents (those of least md5 of doc_id), a documented bound; everything else runs over all rows.

Defined cases: null and empty texts, and texts without letters, are not toxic; null labels are ignored; of several labels of one doc_id the largest counts; rows alike are scored alike; without labels of both kinds nothing is toxic; other columns are carried along by drop_toxic whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, stretches, trimmed

LABELLED, WINDOW, BUCKETS, DIM, MIN_DF, NGRAMS = 6000, 5, 1 << 18, 6, 4, (3, 4, 5)
LETTERS = regex.compile(r"\p{L}+")
NEVER = -1e9


@dataclass
class Model:
    """Per bucket the difference of the two softmax logits; a window's logit is the mean over words of the mean over features, plus bias."""

    weights: np.ndarray
    bias: float
    threshold: float


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features of all words, and where each word's begin."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(code))
    ids, owners = [], []
    h = code * np.uint64(0x9E3779B97F4A7C15)
    rolled = h
    for n in range(2, max(NGRAMS) + 1):
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[n - 1 :]
        if n in NGRAMS:
            fit = left[: len(rolled)] >= n
            x = rolled[fit]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            ids.append((x >> np.uint64(20)) % np.uint64(buckets))
            owners.append(word[: len(rolled)][fit])
    ids.append(np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids).astype(np.int64)[order], np.searchsorted(owner[order], np.arange(len(words)))


def all_features(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """features of many words, a part at a time."""
    ids, starts, at = [], [], 0
    for lo in range(0, len(words), step):
        i, s = features(words[lo : lo + step])
        ids.append(i.astype(np.int32))
        starts.append(s + at)
        at += len(i)
    return np.concatenate(ids), np.concatenate(starts)


class Scores(dict):
    """word -> place in a growing table of word logits; emptied between batches when it is large."""

    LIMIT = 150_000

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.new, self.table = weights, [], np.empty(0, np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and word numbers."""
        if len(self) > self.LIMIT:
            self.clear()
            self.table = np.empty(0, np.float32)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            ids, starts = features(self.new, len(self.weights))
            sums = np.add.reduceat(self.weights[ids], starts) / np.diff(np.append(starts, len(ids)))
            self.table = np.append(self.table, sums.astype(np.float32))
            self.new = []
        return self.table[at], at


def runs_once(ids: np.ndarray) -> np.ndarray:
    """Without words that repeat the word before."""
    return ids[np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else ids


def window_means(scores: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mean of every window of `window` neighbours; of all, if there are fewer."""
    n = min(window, len(scores))
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (c[n:] - c[:-n]) / n


def text_logits(texts: list[str | None], memo: Scores, most: int = 200_000) -> np.ndarray:
    """The highest window mean of each text, before the bias; NEVER without words."""
    out = np.full(len(texts), NEVER)
    held: list[str] = []
    spans: list[tuple[int, int]] = []

    def flush() -> None:
        scores, ids = memo.of(held)
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]])

        def spots(at: int, n: int) -> np.ndarray:
            here = fresh[at : at + n].copy()
            here[0] = True
            return at + np.flatnonzero(here)

        at = 0
        for row, n in spans:
            out[row] = window_means(scores[spots(at, n)]).max()
            at += n
        held.clear()
        spans.clear()

    for row, text in enumerate(texts):
        words = LETTERS.findall((text or "").lower())
        if words:
            held.extend(words)
            spans.append((row, len(words)))
            if len(held) > most:
                flush()
    if held:
        flush()
    return out


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 3, epochs: int = 60, seed: int = 0, decay: float = 1e-5, prior: float = 8.0, start: float = 8.0, rate: float = 0.02) -> Model | None:
    """None if the labels are all alike."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [runs_once(np.fromiter((index.setdefault(w, len(index)) for w in LETTERS.findall((t or "").lower())), np.int32)) for t in texts]
    use = np.array([len(d) > 0 for d in docs])
    if not (toxic & use).any() or not (~toxic & use).any():
        return None
    docs, toxic = [d for d, u in zip(docs, use, strict=True) if u], toxic[use]
    held = np.zeros(len(docs), bool)
    for kind in (True, False):
        of = rng.permutation(np.flatnonzero(toxic == kind))
        held[of[: len(of) // 5]] = True
    ids, starts = all_features(list(index))
    ends = np.append(starts[1:], len(ids))
    sizes = ends - starts
    # document frequencies of features, by class, over the documents that are fitted
    df = np.zeros((2, BUCKETS))
    for d, t, h in zip(docs, toxic, held, strict=True):
        if not h:
            u = np.unique(d)
            seen = np.zeros(BUCKETS, bool)
            seen[ids[stretches(starts[u], sizes[u])]] = True
            df[int(t)] += seen
    keep = df.sum(0) >= MIN_DF
    n1, n0 = (toxic & ~held).sum(), (~toxic & ~held).sum()
    # smoothed by what one document more of either class would say, so that rare features start near 0
    odds = np.where(keep, np.log((df[1] + prior * n1 / (n0 + n1)) / (n1 + prior)) - np.log((df[0] + prior * n0 / (n0 + n1)) / (n0 + prior)), 0.0)
    words = np.add.reduceat(odds[ids], starts) / sizes
    # the first dimension starts at the log odds, the others at random
    embed = (rng.normal(0, 0.05, (BUCKETS, DIM)) * keep[:, None]).astype(np.float32)
    embed[:, 0] += odds
    head = np.concatenate([[start], rng.normal(0, 0.2, DIM - 1)]).astype(np.float32)
    bias = 0.0
    trained = np.zeros(BUCKETS, bool)
    state: dict[str, list] = {}

    def adam(name: str, value, grad, rate: float, step: int):
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        return value - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    step = 0
    for _ in range(rounds):
        picked, target = [], []
        for d, t, h in zip(docs, toxic, held, strict=True):
            if h:
                continue
            means = window_means(words[d])
            best = [int(means.argmax())] if t else [int(means.argmax()), int(rng.integers(len(means)))]
            for at in best:
                picked.append(d[at : at + WINDOW])
                target.append(t)
        y = np.array(target, np.float32)
        cost = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))).astype(np.float32)
        flat = np.concatenate(picked)
        length = np.array([len(p) for p in picked])
        wstart = np.concatenate([[0], np.cumsum(length)[:-1]])
        vocab, local = np.unique(flat, return_inverse=True)
        fsize = sizes[vocab]
        fids = ids[stretches(starts[vocab], fsize)]
        owner = np.repeat(np.arange(len(vocab)), fsize)
        fids, owner = fids[keep[fids]], owner[keep[fids]]  # the others weigh nothing
        used, fl = np.unique(fids, return_inverse=True)
        by_feature = np.argsort(fl, kind="stable")
        feature_start = np.searchsorted(fl[by_feature], np.arange(len(used)))
        by_word = np.argsort(local, kind="stable")
        word_start = np.searchsorted(local[by_word], np.arange(len(vocab)))
        with_features, fstart = np.unique(owner, return_index=True)
        window_of = np.repeat(np.arange(len(picked)), length)
        sub = embed[used]
        state.pop("e", None)
        for _ in range(epochs):
            step += 1
            vecs = np.zeros((len(vocab), DIM), np.float32)
            vecs[with_features] = np.add.reduceat(sub[fl], fstart, axis=0)
            vecs /= fsize[:, None]
            bags = np.add.reduceat(vecs[local], wstart, axis=0) / length[:, None]
            p = 1 / (1 + np.exp(-np.clip(bags @ head + bias, -30, 30)))
            g = ((p - y) * cost / len(y)).astype(np.float32)
            dhead = bags.T @ g + 1e-5 * head
            dbag = (g / length)[:, None] * head[None]
            dvec = np.add.reduceat(dbag[window_of[by_word]], word_start, axis=0) / fsize[:, None]
            dsub = (np.add.reduceat(dvec[owner[by_feature]], feature_start, axis=0) + decay * sub)
            # Adam per round on the features in use; the head and bias keep their state
            sub = adam("e", sub, dsub, rate, step).astype(np.float32)
            head = adam("h", head, dhead, rate, step).astype(np.float32)
            bias = float(adam("b", np.array([bias]), np.array([g.sum()]), 0.1, step)[0])
        embed[used] = sub
        trained[used] = True
        weights = np.where(trained & keep, embed @ head, 0).astype(np.float32)
        words = np.add.reduceat(weights[ids], starts) / sizes
    top = np.array([window_means(words[d]).max() for d in docs]) + bias
    judge = held if held.any() and toxic[held].any() and (~toxic[held]).any() else ~held
    s, t = top[judge], toxic[judge]
    order = np.argsort(-s)
    hit = np.cumsum(t[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + t.sum())
    best = int(f1.argmax())
    below = s[order[best + 1]] if best + 1 < len(s) else s[order[best]] - 1
    return Model(weights, bias, float((s[order[best]] + below) / 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> pd.DataFrame:
    """Texts and labels of at most `most` labelled documents, those of least md5 of doc_id; the broadcast side has that many rows at most."""
    batches(docs.sparkSession)
    asked = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *columns])).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    asked = asked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(asked), "doc_id")
    # one text a document, the least, before anything reaches the driver
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in columns])
    return rows.toPandas().sort_values("doc_id").reset_index(drop=True)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    sample = labelled_sample(docs, labels, ["toxic"], labelled)
    texts, toxic = sample["text"].tolist(), (sample["toxic"] > 0).to_numpy()
    # what brought the sample here goes before the fit needs room
    del sample
    trimmed()
    model = fit(texts, toxic) if texts else None
    del texts
    trimmed()
    return model


def logit(model: Model, text: Column) -> Column:
    """Logit of the most toxic window above the threshold: toxic if positive."""
    shift = model.bias - model.threshold
    weights = model.weights

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Scores(weights)

        def logits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(text_logits(part.tolist(), memo) + shift)

        yield from lean(logits)(parts)

    return run(text)


def toxic_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, toxicity (above 0.5), toxic (true) of every document that is rejected."""
    model = train(docs, labels, labelled)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("toxicity"), F.lit(True).alias("toxic")).where(F.lit(False))
    scored = docs.select("doc_id", logit(model, F.col("text")).alias("z"))
    return scored.where("z > 0").select("doc_id", (1 / (1 + F.exp(-F.col("z")))).alias("toxicity"), F.lit(True).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """docs without the rejected ones, all columns unchanged."""
    model = train(docs, labels, labelled)
    return docs if model is None else docs.where(logit(model, F.col("text")) <= 0)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
