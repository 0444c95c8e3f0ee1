"""Suffix-array dedup by column-wise construction of a document collection's Burrows-Wheeler transform.

A collection (the different stretches of a batch of anchor groups) is sorted column by column: round j inserts, for every text that still has one, its suffix of length j, that is one symbol per text. Where it goes follows from the first symbol and the place of the suffix one shorter; the transform, the common-prefix lengths with the predecessor and the generalised suffix array grow along, and the prefix lengths of the newcomers and of their successors come from a range minimum over the column before. No suffix is ever compared symbol by symbol.

When the rounds are over, neighbours with a common prefix of at least WINDOW words start equal passages. A passage that several documents have is a repeat; its first occurrence by (doc_id, text hash, place) stays, the others are `later`.

Symbols are words (32 bits of the word's hash; the anchor is matched with 64 bits of 20 words besides). A repeat is counted across documents: one that is in a single document only is left alone.

Defined cases: null, empty and short texts have no repeat; each different text without a doc_id is a document of its own; rows alike in doc_id and text are one document and get the same spans and cuts; rows with the same doc_id and different texts are scanned each but aren't `several documents`; ties are broken by (doc_id, text hash, place); other columns are carried along by drop_repeats whatever their names; an empty table gives an empty result; doc_id must be an integer. A document that consists of later repeats only is left out by drop_repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, WINDOW, Stretches, gathered, marked, merged, span_batch
from .common import NULL_ID, columns_of, discard, identity, real_id, rowwise, small_side, staged, stretches

_LOW = np.int64((1 << 32) - 1)


class RangeMin:
    """Minimum of a[lo..hi] for many ranges, by doubling."""

    def __init__(self, a: np.ndarray, longest: int) -> None:
        self.levels = [a]
        size = 1
        while size * 2 <= longest:
            m = self.levels[-1]
            self.levels.append(np.minimum(m[:-size], m[size:]))
            size *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            m = self.levels[k]
            out[at] = np.minimum(m[lo[at]], m[hi[at] - (1 << k) + 1])
        return out


def collection(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, text, length) of all suffixes in order, the empty one of each text included.

    Symbols are integers above 0; text ends sort below all and by text number; bwt has 0 where a text begins; lcp (at most 255) is with the predecessor; suffixes are named by text and length.
    """
    d = len(starts)
    ends = starts + sizes
    key = np.arange(d, dtype=np.int64)  # first symbol << 32 | place of the suffix without it
    lcp = np.zeros(d, np.uint8)
    text = np.arange(d, dtype=np.int32)
    length = np.zeros(d, np.int16)
    bwt = np.where(sizes > 0, symbols[np.maximum(ends - 1, 0)], 0).astype(np.int32)
    place = np.arange(d, dtype=np.int64)
    alive = np.flatnonzero(sizes > 0)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        alive = alive[sizes[alive] >= j]
        symbol = symbols[ends[alive] - j].astype(np.int64)
        fresh = (symbol << np.int64(32)) | place[alive]
        order = np.argsort(fresh, kind="stable")
        fresh, who = fresh[order], alive[order]
        into = np.searchsorted(key, fresh)
        old = len(key)
        shift = np.cumsum(np.bincount(into, minlength=old + 1))[:old]
        to_old = np.arange(old) + shift
        to_new = into + np.arange(len(into))
        total = old + len(into)
        k = np.empty(total, np.int64)
        k[to_old], k[to_new] = key, fresh
        # prefix lengths, over the column before
        touched = np.unique(np.concatenate([to_new, to_new + 1]))
        touched = touched[(touched > 0) & (touched < total)]
        a, b = k[touched - 1], k[touched]
        same = ((a >> np.int64(32)) == (b >> np.int64(32))) & (b > _LOW)
        lo, hi = (a[same] & _LOW) + 1, b[same] & _LOW
        value = np.zeros(len(touched), np.uint8)
        if len(lo):
            least = RangeMin(lcp, int((hi - lo).max()) + 1)(lo, hi)
            value[same] = np.minimum(least, 254) + 1
        grown = np.empty(total, np.uint8)
        grown[to_old] = lcp
        grown[touched] = value
        lcp = grown
        key = k + shift[k & _LOW]
        for_text, for_length, for_bwt = np.empty(total, np.int32), np.empty(total, np.int16), np.empty(total, np.int32)
        for_text[to_old], for_text[to_new] = text, who
        for_length[to_old], for_length[to_new] = length, j
        before = ends[who] - j - 1
        for_bwt[to_old], for_bwt[to_new] = bwt, np.where(sizes[who] > j, symbols[np.maximum(before, 0)], 0)
        text, length, bwt = for_text, for_length, for_bwt
        place[who] = to_new
    return bwt, lcp, text, length


def _decide(window: int):
    def decide(s: Stretches) -> Iterator[pa.RecordBatch]:
        own = s.own.astype(np.int64)
        first = s.first_of
        sizes = own[first] + window - 1
        flat = s.words[stretches(s.at[first], sizes)]
        _, symbols = np.unique(flat, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        _, lcp, text, length = collection(symbols.astype(np.int64) + 1, starts, sizes)
        passage = np.cumsum(lcp < window)
        long = length >= window
        text, length, passage = text[long].astype(np.int64), length[long].astype(np.int64), passage[long]
        # passage number of each window of each kind
        wstart = np.cumsum(own[first]) - own[first]
        number = np.empty(int(own[first].sum()), np.int64)
        _, number[wstart[text] + sizes[text] - length] = np.unique(passage, return_inverse=True)
        count = int(number.max()) + 1 if len(number) else 0
        # every occurrence of every window, in order of (doc, fp, start) within its passage
        of_window = np.repeat(np.arange(len(own)), own)
        offset = stretches(np.zeros(len(own), np.int64), own)
        p = number[wstart[s.kind[of_window]] + offset]
        docs, doc = np.unique(identity(s.doc, s.fp), return_inverse=True)
        least, most = np.full(count, len(docs)), np.full(count, -1)
        np.minimum.at(least, p, doc[of_window])
        np.maximum.at(most, p, doc[of_window])
        several = least != most
        live = several[p]
        if not live.any():
            return
        of_window, offset, p = of_window[live], offset[live], p[live]
        _, who = np.unique(np.stack([s.doc, s.fp]), axis=1, return_inverse=True)
        who = who.reshape(-1)
        at = s.start[of_window] + offset
        rank = np.lexsort((at, who[of_window], p))
        lead = np.zeros(len(p), bool)
        lead[rank[np.flatnonzero(np.concatenate([[True], p[rank][1:] != p[rank][:-1]]))]] = True
        # an occurrence met twice (a text in two overlapping pieces) is the same occurrence
        later = ~lead
        r = p[rank], who[of_window][rank], at[rank]
        again = np.concatenate([[False], (r[0][1:] == r[0][:-1]) & (r[1][1:] == r[1][:-1]) & (r[2][1:] == r[2][:-1])])
        if again.any():
            later[rank[again]] = later[rank[np.flatnonzero(again) - 1]]
        # runs of neighbouring windows alike in `later`
        begin = np.flatnonzero(np.concatenate([[True], (of_window[1:] != of_window[:-1]) | (offset[1:] != offset[:-1] + 1) | (later[1:] != later[:-1])]))
        stop = np.concatenate([begin[1:], [len(p)]]) - 1
        o = of_window[begin]
        yield span_batch(s.doc[o], s.fp[o], at[begin], at[stop] + window, later[begin])

    return decide


def repeat_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Repeats as spans of words: doc, fp, start, end, later; one passage may come in several spans."""
    return gathered(docs, _decide(window), window, gram)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) of every maximal stretch covered by repeated passages, and dup_words, its words that are in a later occurrence."""
    return merged(repeat_spans(docs, window, gram)).select(real_id(), "start_word", "end_word", "dup_words")


_WORDS = re.compile(rb"[^ \t\n\x0b\f\r]+")


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """text without the words in cuts (disjoint, in order), each with the white space that follows it."""
    spans = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in cuts:
        out.append(text[at : spans[start]])
        at = spans[min(end, len(spans) - 1)]
    out.append(text[at:])
    return b"".join(out)


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, with the columns of docs, without the later occurrences; documents that lose every word are left out."""
    spans = staged(repeat_spans(docs, window, gram), "spans")
    cuts = staged(marked(spans), "cuts")
    discard(spans)
    joined = rowwise(docs).join(small_side(cuts, F.size("cuts") * 32 + 64), ["doc", "fp"], "left")

    @F.udf("string", useArrow=True)
    def cut(text, spans):
        return None if text is None else without(text.encode(), [(x["start"], x["end"]) for x in spans]).decode()

    hit = F.col("cuts").isNotNull()
    # texts without a cut don't go to Python
    done = joined.withColumn("cut", cut(F.when(hit, F.col("row.text").cast("string")), "cuts")).where(~hit | F.col("cut").rlike(r"[^ \t\n\x0B\f\r]"))
    changed = {"text": F.when(hit, F.col("cut")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return columns_of(done, docs, **changed)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WINDOWS = f"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
p AS (SELECT doc_id, text, unnest(range(0, len(w) - {WINDOW - 1})) AS s, w FROM d WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, hash(text) AS fp, s, array_to_string(w[s + 1:s + {WINDOW}], ' ') AS gram FROM p),
c AS (SELECT gram, min((coalesce(doc_id, {NULL_ID}), fp, s)) AS lead FROM g GROUP BY gram HAVING count(DISTINCT coalesce(doc_id, {NULL_ID})) > 1),
x AS (SELECT doc_id, fp, s, s + {WINDOW} AS e, lead <> (coalesce(doc_id, {NULL_ID}), fp, s) AS later FROM g JOIN c USING (gram)),
r AS (SELECT *, max(e) OVER w AS reach, max(CASE WHEN later THEN e END) OVER w AS marked FROM x
      WINDOW w AS (PARTITION BY doc_id, fp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, fp ORDER BY s) AS island FROM r)
"""
SQL = (
    _WINDOWS
    + """
SELECT doc_id, min(s)::BIGINT AS start_word, max(e)::BIGINT AS end_word,
       sum(CASE WHEN later THEN greatest(0, e - greatest(s, coalesce(marked, s))) ELSE 0 END)::BIGINT AS dup_words
FROM i GROUP BY doc_id, fp, island
"""
)
