"""Substring dedup by repeated-phrase automata.

Passages are confirmed first: the stretches of text round recurring anchors (see anchors.py) come together in the shard that owns their anchor, and the windows of WINDOW words that several documents have are known there by hash. Of each run of them the first and the last window are phrases (a run within a stretch is shorter than a window, so these two cover it). Where they are is not kept: the phrases alone are compiled into Aho-Corasick automata over word numbers (pyahocorasick), PHRASES to an automaton at most, and every stretch of every document that has an anchor of the shard streams through each of the shard's automata, confirmed or not. What these locate, and in which documents, decides: a phrase counts if it was located in several documents, and the spans are those of the hits.

A document without a recurring anchor can't have a phrase, so all documents have been searched; sending each through all automata of all shards would cost the square of the corpus.

Defined cases: as for suffix-array dedup: null, empty and short texts have no repeat; each different text without a doc_id is a document of its own; rows alike in doc_id and text are one document; a passage must be in documents with two doc_ids; an empty table gives an empty result; other columns are ignored; doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import GRAM, WINDOW, Stretches, gathered, merged, span_batch
from .common import identity, real_id, stretches
from .suffixes import _WINDOWS


PHRASES = 50_000


def _confirmed(flat: np.ndarray, starts: np.ndarray, own: np.ndarray, window: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where in flat the phrases begin: the first and the last window of each run of windows whose words are in several documents."""
    # a polynomial hash over prefix sums gives every window's hash
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    size = own + window - 1
    place = stretches(np.zeros(len(size), np.int64), size)
    longest = int(size.max())
    power = np.cumprod(np.full(longest, base, np.uint64))
    back = np.cumprod(np.full(longest, inverse, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[place], dtype=np.uint64)])
    kind = np.repeat(np.arange(len(own)), own)
    offset = stretches(np.zeros(len(own), np.int64), own)
    at = starts[kind] + offset
    code = (sums[at + window] - sums[at]) * back[offset]
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    several = np.minimum.reduceat(low[kind[order]], first) != np.maximum.reduceat(high[kind[order]], first)
    live = np.empty(len(code), bool)
    live[order] = np.repeat(several, np.diff(np.append(first, len(code))))
    kind, offset = kind[live], offset[live]
    begin = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (offset[1:] != offset[:-1] + 1)]))[: len(kind)]
    pick = np.unique(np.concatenate([begin, np.append(begin[1:], len(kind)) - 1])) if len(kind) else begin
    return starts[kind[pick]] + offset[pick]


def automata(numbers: list[int], starts: list[int], window: int, most: int) -> Iterator[ahocorasick.Automaton]:
    """Automata of the different phrases numbers[s:s+window], `most` to each at most; a hit gives the phrase's number within its automaton."""
    phrases = list({tuple(numbers[s : s + window]) for s in starts})
    for lo in range(0, len(phrases), most):
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, phrase in enumerate(phrases[lo : lo + most]):
            machine.add_word(phrase, k)
        machine.make_automaton()
        yield machine


def _decide(window: int, most: int = PHRASES):
    def decide(s: Stretches) -> Iterator[pa.RecordBatch]:
        own = s.own.astype(np.int64)
        first = s.first_of
        size = own[first] + window - 1
        flat = s.words[stretches(s.at[first], size)]
        _, words = np.unique(flat, return_inverse=True)
        starts = np.cumsum(size) - size
        who = identity(s.doc, s.fp)
        low, high = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
        phrases = _confirmed(flat, starts, own[first], window, low, high)
        # all stretches as one sequence, with a sign between them that no phrase has
        apart = np.full(len(flat) + len(size), words.max() + 1, np.int64)
        apart[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = words
        text = tuple(apart.tolist())
        ends = starts + size + np.arange(1, len(size) + 1)
        kinds, lasts = [], []
        for machine in automata(words.tolist(), phrases.tolist(), window, most):
            hits = np.array(list(machine.iter(text)), np.int64).reshape(-1, 2)
            k = np.searchsorted(ends, hits[:, 0], side="right")
            least, greatest = np.full(len(machine), np.iinfo(np.int64).max), np.full(len(machine), np.iinfo(np.int64).min)
            np.minimum.at(least, hits[:, 1], low[k])
            np.maximum.at(greatest, hits[:, 1], high[k])
            several = (least != greatest)[hits[:, 1]]
            kinds.append(k[several])
            lasts.append(hits[several, 0] + 1 - (ends - size - 1)[k[several]])
        if not sum(map(len, kinds)):
            return
        k, end = np.concatenate(kinds), np.concatenate(lasts)
        order = np.lexsort((end, k))
        k, end = k[order], end[order]
        # touching hits of a kind as one span
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (end[1:] - window > end[:-1])]))
        k, lo, hi = k[new], end[new] - window, end[np.concatenate([new[1:], [len(end)]]) - 1]
        # for every occurrence of the kind
        bounds = np.append(first, len(own))
        times = np.diff(bounds)[k]
        o = stretches(bounds[k], times)
        yield span_batch(s.doc[o], s.fp[o], s.start[o] + np.repeat(lo, times), s.start[o] + np.repeat(hi, times), np.zeros(len(o), bool))

    return decide


def located(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words of every maximal stretch of words in passages that recur across documents."""
    spans = merged(gathered(docs, _decide(window), window, gram))
    return spans.select(real_id(), "start_word", "end_word", (spans.end_word - spans.start_word).alias("n_words"))


def op5_automata(spark, sf_dir: str) -> DataFrame:
    return located(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = (
    _WINDOWS
    + """
SELECT doc_id, min(s)::BIGINT AS start_word, max(e)::BIGINT AS end_word, (max(e) - min(s))::BIGINT AS n_words
FROM i GROUP BY doc_id, fp, island
"""
)
