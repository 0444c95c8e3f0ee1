"""Where could a passage of WINDOW words recur? Anchors narrow that down without losing any passage.

Of the GRAM-grams inside every window of WINDOW words the one of least hash is its anchor. The choice depends on the window's words alone, so equal windows have equal anchors at equal places: windows whose anchor occurs in one document only can't recur. Documents stream past once to find the anchors that occur in several documents, and the stretches of text around those are then brought together by anchor, where each operator decides exactly.

Window starts with the same anchor occurrence are neighbours; the stretch sent is from the first of them to the end of the last one's window, some 65 words.

A passage that a third of all documents have must not bring a third of all rows to one task. What a task has seen in two documents is known to recur (Known), so of an anchor it sends two occurrences to the task that owns it and tells the others at once; and of a window it sends the least occurrence, which may be the first one of all, and one in another document, and tells the others, which recur and are not the first, at once. What arrives for a passage grows with the number of tasks, not with that of documents; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOB, Hashes, buckets, exchanged, identity, lean, ngram_hashes, packed, partitions, pieces, prepared, small_side, staged, stretches, unpacked

WINDOW, GRAM = 50, 20
_PLACE = np.uint64((1 << 24) - 1)
SPANS = "doc long, fp long, start long, end long, later boolean"


def owned(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes of several texts laid end to end: (anchor hash, first window start, last window start) of each anchor occurrence."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(h) < window:
        return none
    if len(h) > int(_PLACE):
        raise ValueError("too many words at once")
    g = ngram_hashes(h, gram)
    m, size, width = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), 1, window - gram + 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    at = (m & _PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = stretches(ends - sizes, np.maximum(sizes - window + 1, 0))
    if not len(starts):
        return none
    a = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return g[a[new]], starts[new], starts[last]


def _laid(lists: list[list[bytes]], memo: Hashes) -> tuple[np.ndarray, np.ndarray]:
    return memo.of([w for x in lists for w in x]), np.fromiter(map(len, lists), np.int64, len(lists))


class Known:
    """Keys that a task has met in two documents, each with its least occurrence so far; a memory of LIMIT keys, and forgetting some changes no result."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.keys, self.least = np.empty(0, np.uint64), np.empty((0, 0), np.int64)

    def surplus(self, keys: np.ndarray, who: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(spare, again) of occurrences of keys in documents `who`, ordered by `places`. A spare one has a key that recurs, and a lesser occurrence of it is or was sent; `again` is the least occurrence of a key once more, where it is or was sent."""
        n = len(keys)
        if not n:
            return np.empty(0, bool), np.empty(0, bool)
        place = np.stack(places, axis=1).astype(np.int64)
        order = np.lexsort((*place.T[::-1], keys))
        k, w, place = keys[order], who[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        least = place[first]
        # of each key the first occurrence in another document than the least one's
        second = np.full(len(first), n)
        other = np.flatnonzero(w != w[first][of])
        np.minimum.at(second, of[other], other)
        recurs, sent = second < n, np.zeros(n, bool)
        sent[first] = True
        sent[second[recurs]] = True
        met = np.zeros(len(first), bool)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, k[first]), len(self.keys) - 1)
            met = self.keys[spot] == k[first]
            before = self.least[spot]
            # is the least one here less than, or the same as, the least one so far?
            lower, same = np.zeros(len(first), bool), np.ones(len(first), bool)
            for c in range(place.shape[1]):
                lower |= same & (least[:, c] < before[:, c])
                same &= least[:, c] == before[:, c]
            self.least[spot[met & lower]] = least[met & lower]
            alone = np.zeros(n, bool)
            alone[first[lower]] = True
            sent = np.where(met[of], alone, sent)
            least = np.where((met & ~lower)[:, None], before, least)
        spare = (recurs | met)[of] & ~sent
        again = spare & (place == least[of]).all(axis=1)
        fresh = recurs & ~met
        if fresh.any():
            if len(self.keys) + int(fresh.sum()) > self.LIMIT or not len(self.keys):
                self.keys, self.least = k[first][fresh], least[fresh]
            else:
                all_keys, all_least = np.concatenate([self.keys, k[first][fresh]]), np.concatenate([self.least, least[fresh]])
                by_key = np.argsort(all_keys, kind="stable")
                self.keys, self.least = all_keys[by_key], all_least[by_key]
        out = np.zeros((2, n), bool)
        out[:, order] = spare & ~again, again
        return out[0], out[1]


def recurring_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, fp, anchors: the anchors of each document that other documents have too."""
    n = partitions(docs.sparkSession)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = Hashes(), Known()
        for batch in batches:
            doc, fp = (batch.column(c).to_numpy() for c in ("doc", "fp"))
            for lists, rows, _ in pieces(batch, window - 1):
                h, sizes = _laid(lists, memo)
                anchor, first, _ = owned(h, sizes, window, gram)
                row = np.array(rows)[np.searchsorted(np.cumsum(sizes), first, side="right")]
                # once per document
                order = np.lexsort((row, anchor))
                anchor, row = anchor[order], row[order]
                once = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(anchor) else []
                anchor, row = anchor[once], row[once]
                if len(anchor):
                    who = identity(doc[row], fp[row])
                    spare, again = known.surplus(anchor, who, who)
                    sure = spare | again
                    # these go to any task
                    to = np.where(sure, fp[row].view(np.uint64), anchor) >> np.uint64(32)
                    yield packed((to % np.uint64(n)).astype(np.int64), [anchor, doc[row], fp[row], sure], n)

    def meet(cells: list[bytes]) -> Iterator[pa.RecordBatch]:
        anchor, doc, fp, sure = unpacked(cells, [np.uint64, np.int64, np.int64, np.bool_])
        yield pa.RecordBatch.from_arrays([pa.array(doc[sure]), pa.array(fp[sure]), pa.array(anchor[sure].view(np.int64))], names=["doc", "fp", "anchor"])
        anchor, doc, fp = anchor[~sure], doc[~sure], fp[~sure]
        if not len(anchor):
            return
        order = np.argsort(anchor, kind="stable")
        anchor, doc, fp = anchor[order], doc[order], fp[order]
        at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        who = identity(doc, fp)
        several = np.minimum.reduceat(who, at) != np.maximum.reduceat(who, at)
        keep = np.repeat(several, np.diff(np.append(at, len(anchor))))
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(fp[keep]), pa.array(anchor[keep].view(np.int64))], names=["doc", "fp", "anchor"])

    rows = exchanged(docs.mapInArrow(lean(give), BLOB), meet, "doc long, fp long, anchor long", n)
    return rows.groupBy(F.col("doc").alias("d"), F.col("fp").alias("f")).agg(F.collect_set("anchor").alias("anchors"))


@dataclass
class Stretches:
    """Stretches with one anchor or several, whole groups of them, sorted by anchor; alike stretches of a group are one `kind`."""

    anchor: np.ndarray
    doc: np.ndarray
    fp: np.ndarray
    start: np.ndarray  # word offset in the document
    own: np.ndarray  # number of window starts
    kind: np.ndarray  # into first_of
    first_of: np.ndarray  # a stretch of each kind
    words: np.ndarray
    at: np.ndarray  # where each stretch's words begin


def _kinds(anchor: np.ndarray, own: np.ndarray, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each stretch's content."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(at, size).astype(np.uint64)
    x = (words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB) + place * np.uint64(2)
    x ^= x >> np.uint64(29)
    return np.add.reduceat(x, at) + anchor * np.uint64(0xBF58476D1CE4E5B9) + own.astype(np.uint64)


def batches_of(cells: list[bytes], window: int, most: int = 400_000) -> Iterator[Stretches]:
    """A partition's stretches in batches of whole anchor groups with about `most` words of different stretches; a larger group is a batch by itself."""
    anchor, doc, fp, start, own, words = unpacked(cells, [np.uint64, np.int64, np.int64, np.int64, np.int16], np.uint32)
    size = own.astype(np.int64) + window - 1
    at = np.cumsum(size) - size
    content = _kinds(anchor, own, words, at, size)
    order = np.lexsort((start, fp, doc, content, anchor))
    anchor, doc, fp, start, own, size, at, content = (x[order] for x in (anchor, doc, fp, start, own, size, at, content))
    fresh = np.concatenate([[True], (content[1:] != content[:-1]) | (anchor[1:] != anchor[:-1])])
    kind = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    groups = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    work = np.cumsum(np.where(fresh, size, 0))
    lo = 0
    while lo < len(anchor):
        done = work[lo - 1] if lo else 0
        g = np.searchsorted(groups, lo, side="right")
        fit = np.searchsorted(work, done + most, side="right")
        hi = groups[g] if g < len(groups) else len(anchor)
        if fit > hi:
            hi = groups[np.searchsorted(groups, fit, side="right") - 1] if fit < len(anchor) else len(anchor)
        s = slice(lo, hi)
        k0, k1 = kind[lo], kind[hi - 1]
        firsts = first[k0 : k1 + 1]
        yield Stretches(anchor[s], doc[s], fp[s], start[s], own[s], kind[s] - k0, firsts - lo, words, at[s])
        lo = hi


def gathered(docs: DataFrame, decide: Callable[[Stretches], Iterator[pa.RecordBatch]], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Run decide on the stretches of every recurring anchor, brought together by anchor; the result has columns SPANS. decide says what is in a stretch of the windows that recur among those that it gets; windows that are known to recur and to be no first occurrence are later ones without it."""
    if window < gram + 1 or window > 250:
        raise ValueError(f"window must be over {gram} and at most 250 words")
    docs = prepared(docs)
    anchors = staged(recurring_anchors(docs, window, gram), "anchors")
    met = anchors.agg(F.sum(F.size("anchors")).alias("n")).first()["n"] or 0
    n = buckets(docs.sparkSession, met * (40 + 4 * (2 * window - gram)))
    anchors = small_side(anchors, F.size("anchors") * 8 + 64)
    # rows alike in doc_id and text are one document
    there = docs.join(anchors, (F.col("doc") == F.col("d")) & (F.col("fp") == F.col("f"))).select("doc", "fp", "text", "anchors")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = Hashes(), Known()
        salt = np.uint64(0xA24BAED4963EE407)
        for batch in batches:
            doc, fp = (batch.column(c).to_numpy() for c in ("doc", "fp"))
            lists_ = batch.column("anchors")
            listed = lists_.flatten().to_numpy().view(np.uint64)
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(lists_.offsets.to_numpy())).astype(np.uint64)
            wanted = np.sort(listed + of_row * salt)
            for lists, rows, offsets in pieces(batch, window - 1):
                h, sizes = _laid(lists, memo)
                anchor, first, last = owned(h, sizes, window, gram)
                if not len(anchor):
                    continue
                part = np.searchsorted(np.cumsum(sizes), first, side="right")
                row = np.array(rows)[part]
                asked = anchor + row.astype(np.uint64) * salt
                spot = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
                keep = wanted[spot] == asked
                anchor, first, last, part, row = anchor[keep], first[keep], last[keep], part[keep], row[keep]
                if not len(anchor):
                    continue
                begin = (np.cumsum(sizes) - sizes)[part]
                own = last - first + 1
                # every window of every stretch
                of = np.repeat(np.arange(len(own)), own)
                at = stretches(first, own)
                place = at - begin[of] + np.array(offsets)[part][of]
                d, f = doc[row[of]], fp[row[of]]
                sure, again = known.surplus(ngram_hashes(h, window)[at], identity(d, f), d, f, place)
                of, at, place, sure = of[~again], at[~again], place[~again], sure[~again]
                # stretches fall apart into runs of windows that are alike in this
                cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (sure[1:] != sure[:-1])])) if len(of) else np.empty(0, np.int64)
                o, at, place, own, sure = of[cut], at[cut], place[cut], np.diff(np.append(cut, len(of))), sure[cut]
                if sure.any():
                    r = row[o[sure]]
                    # their cells have buckets from n on
                    yield packed(n + (fp[r].view(np.uint64) % np.uint64(n)).astype(np.int64), [doc[r], fp[r], place[sure], place[sure] + own[sure] + window - 1], 2 * n)
                o, at, place, own = o[~sure], at[~sure], place[~sure], own[~sure]
                if not len(o):
                    continue
                bucket = ((anchor[o] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                yield packed(bucket, [anchor[o], doc[row[o]], fp[row[o]], place, own.astype(np.int16)], n, ((h >> np.uint64(32)).astype(np.uint32), at, own + window - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[bytes] = []
        for batch in batches:
            for bucket, cell in zip(*(batch.column(c).to_pylist() for c in ("bucket", "payload")), strict=True):
                if bucket < n:
                    cells.append(cell)
                else:
                    told = unpacked([cell], [np.int64] * 4)
                    yield span_batch(*told, np.ones(len(told[0]), bool))
        if cells:
            for some in batches_of(cells, window):
                yield from decide(some)

    return there.mapInArrow(lean(give), BLOB).repartitionById(n, F.pmod("bucket", F.lit(n))).mapInArrow(lean(run), SPANS)


def span_batch(doc: np.ndarray, fp: np.ndarray, start: np.ndarray, end: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(fp), pa.array(start), pa.array(end), pa.array(later)], names=["doc", "fp", "start", "end", "later"])


def merged(spans: DataFrame) -> DataFrame:
    """Touching spans of a document as one: doc, fp, start_word, end_word (exclusive), dup_words (words in spans marked `later`)."""
    w = Window.partitionBy("doc", "fp").orderBy("start", "end", "later")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("reach", F.max("end").over(ahead)).withColumn("marked", F.max(F.when(F.col("later"), F.col("end"))).over(ahead))
    s = s.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.when(F.col("later"), F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("marked", "start")))).otherwise(0)
    return s.withColumn("gain", gain).groupBy("doc", "fp", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.sum("gain").cast("long").alias("dup_words")).drop("island")


def marked(spans: DataFrame) -> DataFrame:
    """The words in spans marked `later`, as lists per document: doc, fp, cuts array<struct<start,end>>, disjoint and in order."""
    later = spans.where("later")
    w = Window.partitionBy("doc", "fp").orderBy("start", "end")
    s = later.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = s.groupBy("doc", "fp", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("doc", "fp").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
