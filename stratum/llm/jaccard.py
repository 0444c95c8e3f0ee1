"""N-gram Jaccard join over a token-group matrix.

A document is the set of its word 3-grams (64-bit hashes; a shorter document has one gram, of all its words). Documents with the same set are one set. Sets are partitioned into groups of similar ones: those with the same least gram under an independent hash (two sets share it with the probability of their Jaccard similarity). The matrix says which groups hold which grams; a query's overlap with the union of a group's grams bounds its similarity to every member, overlap / size of the query, so only groups whose bound reaches the threshold are opened and their members compared exactly.

Which (query, group) cells have to be bounded at all is found by prefixes: grams are ordered rarest first (by a fixed-size sketch of counts over all documents), and two sets can only reach the threshold if their prefixes share a number of grams that grows with their sizes (SHARED of the smaller one's). A cell counts the grams of the query's prefix that any prefix of the group has, in 32 bits a gram beside the bucket's; grams of a set that are alike there are told apart by their number, so a count is never too low. Every set meets its own group. Nothing is sampled and nothing is capped: the search misses no pair.

Groups that cells connect are opened together in one unit, so that a text travels once to all of them; a unit holds at most MOST grams of members. A larger group is split into blocks of members, and each of its sets is sent to every block of its group. Within a unit grams that a single set has are left aside, grams of few sets are met as pairs, and only the others become columns of a matrix product.

The result is one row a document: its class (the connected component of all pairs that reach the threshold) and the number of documents that it reaches the threshold with. Links between different texts are all found and counted; copies are counted with their set and not expanded into pairs.

Defined cases: null and empty texts have no gram, no partner and no row; rows alike in doc_id and text are one document, other rows are documents of their own whatever their doc_id; a class is named by its least doc_id that isn't null; in drop_near a null doc_id sorts first; ties don't matter, every pair at the threshold (to 1e-9) is a link; other columns are carried along by drop_near whatever their names; an empty table gives an empty result; doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOB, Hashes, Linked, buckets, columns_of, components, discard, exchanged, lean, mix, ngram_hashes, packed, partitions, pieces, prepared, real_id, rowwise, small_side, staged, stretches, trimmed, unpacked

N, THRESHOLD, SKETCH, SHARED, MOST = 3, 0.5, 1 << 22, 0.05, 1_000_000
_GROUP, _TOKEN = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1B54A32D192ED03)
#: A gram that at most so many of a group's rows have is met as pairs of rows.
RARE = 8


def _sets(batch: pa.RecordBatch, memo: Hashes, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sizes, grams): the distinct grams of each row that has words, rows in order, grams in order of their leading bits."""

    def unique(row: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # one key of the row and the leading bits sorts several times faster than two keys
        order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
        row, grams = row[order], grams[order]
        near = np.flatnonzero((row[1:] == row[:-1]) & ((grams[1:] >> np.uint64(20)) == (grams[:-1] >> np.uint64(20))) & (grams[1:] != grams[:-1]))
        if len(near):  # different grams alike in the leading bits: sort these rows in full
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])]) if len(row) else np.empty(0, bool)
        return row[once], grams[once]

    def done(row: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        return row[first], np.diff(np.append(first, len(row))), grams

    # a document of many words may go on in the next piece, so the last one is held back
    rest = np.empty(0, np.int64), np.empty(0, np.uint64)
    for lists, rows, offsets in pieces(batch, n - 1):
        h = memo.of([w for x in lists for w in x])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ends, rows_ = np.cumsum(sizes), np.array(rows, np.int64)
        at = stretches(ends - sizes, np.maximum(sizes - n + 1, 0))
        row = np.repeat(rows_, np.maximum(sizes - n + 1, 0))
        grams = ngram_hashes(h, n)[at] if len(at) else np.empty(0, np.uint64)
        short = np.flatnonzero((sizes < n) & (sizes > 0) & (np.array(offsets) == 0))
        whole = [ngram_hashes(h[ends[i] - sizes[i] : ends[i]], int(sizes[i]))[0] ^ np.uint64(sizes[i]) for i in short]
        row, grams = unique(np.concatenate([rest[0], row, rows_[short]]), np.concatenate([rest[1], grams, np.array(whole, np.uint64)]))
        last = row == rows_[-1]
        rest = row[last], grams[last]
        if not last.all():
            yield done(row[~last], grams[~last])
    if len(rest[0]):
        yield done(*rest)


def _identity(sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    at = np.cumsum(sizes) - sizes
    return mix(np.add.reduceat(mix(grams ^ np.uint64(0x2545F4914F6CDD1D)), at) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _group(sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The group of each set, in 32 bits; groups that share them are one."""
    return mix(np.minimum.reduceat(mix(grams ^ _GROUP), np.cumsum(sizes) - sizes)) >> np.uint64(32)


def _needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap with a partner."""
    return np.maximum(np.ceil(threshold * sizes - 1e-9), 1).astype(np.int64)


def _shared(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(SHARED * sizes), 1).astype(np.int64)


def scanned(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, size: int = SKETCH) -> tuple[DataFrame, np.ndarray]:
    """(sets, sketch) in one pass over the texts: doc, fp, sid, g, size, ask of all documents with grams (the set, its group, its grams, and how many of these its cells must share); and per bucket of gram hashes the logarithm of the number of documents' grams in it, over all documents. The sketch's size doesn't depend on theirs."""
    chunks = 16
    schema = "doc long, fp long, sid long, g long, size long, ask long, bucket int, payload binary"
    names = ["doc", "fp", "sid", "g", "size", "ask", "bucket", "payload"]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = Hashes(), np.zeros(size, np.uint32)
        some = False
        for batch in batches:
            doc, fp = (batch.column(c).to_numpy() for c in ("doc", "fp"))
            for rows, sizes, grams in _sets(batch, memo, n):
                np.add.at(total, (grams >> np.uint64(20)).astype(np.int64) & (size - 1), np.uint32(1))
                some = True
                ask = _shared(_needed(sizes, threshold))
                columns = [doc[rows], fp[rows], _identity(sizes, grams).view(np.int64), _group(sizes, grams).view(np.int64), sizes, ask]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
        if some:
            none = [pa.nulls(chunks, pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(chunks), pa.int32()), pa.array([x.tobytes() for x in np.split(total, chunks)], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(cell, np.uint32).astype(np.uint64)
                sums[b] = sums[b] + x if b in sums else x
        if sums:
            logs = [np.minimum(np.rint(8 * np.log2(1 + x)), 255).astype(np.uint8) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in logs], pa.binary())], names=["bucket", "payload"])

    both = staged(docs.mapInArrow(lean(give), schema), "sets")
    counts = both.where(F.col("bucket").isNotNull()).select("bucket", "payload")
    rows = counts.repartition(min(chunks, partitions(docs.sparkSession)), "bucket").mapInArrow(add, BLOB).collect()
    out = np.zeros((chunks, size // chunks), np.uint8)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(r["payload"], np.uint8)
    sets = both.where(F.col("bucket").isNull()).select(*names[:6])
    sets.stage_path = both.stage_path
    return sets, out.reshape(-1)


def _class(size: np.ndarray) -> np.ndarray:
    """Sizes in eighths of an octave, rounded down."""
    return np.minimum(np.floor(8 * np.log2(np.maximum(size, 1)) + 1e-9), 255).astype(np.uint8)


def prefixes(sizes: np.ndarray, grams: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, most): the prefix of each set, and the class of the greatest size that a partner may have if this token is to be among those that they share. The larger a partner, the more grams must be shared and the shorter is the prefix that has to have some of them."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    rare = sketch[(grams >> np.uint64(20)).astype(np.int64) & (len(sketch) - 1)].astype(np.uint64)
    # ties by the whole hash, alike in every set
    order = np.argsort((of.astype(np.uint64) << np.uint64(44)) | (rare << np.uint64(36)) | (grams >> np.uint64(28)), kind="stable")
    grams = grams[order]
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    need = _needed(sizes, threshold)
    shared = np.minimum(_shared(sizes), need)
    keep = place < (sizes - need + shared)[of]
    of, place = of[keep], place[keep]
    # place < size - overlap + shared, where overlap = threshold / (1 + threshold) * (size + partner)
    most = (sizes + shared)[of] - place
    return of, mix(grams[keep] ^ _TOKEN), _class(most * (1 + threshold) / threshold - sizes[of] + 1e-6)


def _numbered(row: np.ndarray, bucket: np.ndarray, token: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((token, row, bucket))
    row, bucket, token, most = row[order], bucket[order], token[order], most[order]
    again = np.flatnonzero((row[1:] == row[:-1]) & (bucket[1:] == bucket[:-1]) & (token[1:] == token[:-1])) + 1
    number = 0
    for k, at in enumerate(again.tolist()):
        number = number + 1 if k and again[k - 1] == at - 1 else 1
        token[at] ^= np.uint32((number * 0x9E3779B1) & 0xFFFFFFFF)
        most[at] = most[at - number] = max(most[at], most[at - number])
    return row, bucket, token, most


def _cells(docs: DataFrame, info: DataFrame, sketch: np.ndarray, total: int, n: int, threshold: float) -> DataFrame:
    """Cells of the matrix in which the query's prefix shares enough grams with those of a group of greater number: q, qg, g. q is the group's 32 bits and 32 of the set's; sets that share them are bounded together. info: q, ask. total: grams of all sets."""
    parts = buckets(docs.sparkSession, 14 * total)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for batch in batches:
            seen: set[int] = set()
            for _, sizes, grams in _sets(batch, memo, n):
                who = (_group(sizes, grams) << np.uint64(32)) | (_identity(sizes, grams) & np.uint64(0xFFFFFFFF))
                row, token, most = prefixes(sizes, grams, sketch, threshold)
                # copies within a batch come once
                fresh = np.array([not (w in seen or seen.add(w)) for w in who.tolist()], bool)
                live = fresh[row]
                row, token, most = row[live], token[live], most[live]
                if not len(row):
                    continue
                bucket = ((token >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                row, bucket, token, most = _numbered(row, bucket, token.astype(np.uint32), most)
                yield packed(bucket, [token, who[row], _class(sizes)[row], most], parts)

    def meet(cells: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, who, size, most = unpacked(cells, [np.uint32, np.uint64, np.uint8, np.uint8])
        sets, number = np.unique(who, return_inverse=True)
        # of copies the one that admits most stands for all
        key = (token.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
        order = np.lexsort((255 - most, key))
        order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
        token, s, size_of, most = token[order], number[order].astype(np.int64), size[order], most[order]
        groups, gnumber = np.unique((sets >> np.uint64(32)).astype(np.int64), return_inverse=True)
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(at, len(token)))
        live = size > 1
        at, size = at[live], size[live]
        width = max(len(groups), 1)
        found, times = np.empty(0, np.int64), np.empty(0, np.int64)
        seen: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        pending = 0

        def settle() -> None:
            nonlocal found, times, seen, weights, pending
            cells_, counts = np.concatenate([found, *seen]), np.concatenate([times, *weights])
            found, inverse = np.unique(cells_, return_inverse=True)
            times = np.bincount(inverse, counts, len(found)).astype(np.int64)
            seen, weights, pending = [], [], 0

        # sets are in order of their groups, and one direction is enough: to the group of greater number
        two = size == 2
        i, j = at[two], at[two] + 1
        apart = (gnumber[s[i]] < gnumber[s[j]]) & (size_of[i] <= most[j]) & (size_of[j] <= most[i])
        seen.append(s[i[apart]] * width + gnumber[s[j[apart]]])
        weights.append(np.ones(len(seen[0]), np.int64))
        for f, k in zip(at[~two].tolist(), size[~two].tolist(), strict=True):
            members, own = s[f : f + k], gnumber[s[f : f + k]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            g = own[first]
            if len(g) < 2:
                continue
            # a group by its smallest member and the one that admits most
            least, admits = np.minimum.reduceat(size_of[f : f + k], first), np.maximum.reduceat(most[f : f + k], first)
            step = max(1, 1_000_000 // len(g))
            for lo in range(0, k, step):
                m, of = members[lo : lo + step], own[lo : lo + step]
                later = len(g) - np.searchsorted(g, of, side="right")
                to = stretches(len(g) - later, later)
                fit = (least[to] <= np.repeat(most[f + lo : f + lo + len(m)], later)) & (np.repeat(size_of[f + lo : f + lo + len(m)], later) <= admits[to])
                seen.append((np.repeat(m, later) * width + g[to])[fit])
                weights.append(np.ones(len(seen[-1]), np.int64))
                pending += len(seen[-1])
                if pending > 1_000_000:
                    settle()
        settle()
        for lo in range(0, len(found), 200_000):
            x, y = found[lo : lo + 200_000] // width, found[lo : lo + 200_000] % width
            yield pa.RecordBatch.from_arrays([pa.array(sets[x].view(np.int64)), pa.array(groups[y]), pa.array(times[lo : lo + 200_000])], names=["q", "g", "times"])

    met = exchanged(docs.mapInArrow(lean(give), BLOB), meet, "q long, g long, times long", parts)
    counted = met.groupBy("q", "g").agg(F.sum("times").alias("times"))
    return counted.join(info, "q").where("times >= ask").select("q", F.shiftrightunsigned("q", 32).alias("qg"), "g")


def compare(members: np.ndarray, queries: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int, threshold: float, inner: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of all members (if inner), once each, and of queries and members that reach the threshold. Row r has the grams ids[at[r]:at[r+1]], numbers below width. Queries whose overlap with the union of the members can't reach it are not compared."""
    sizes = np.diff(at)

    def overlaps(mark: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat = mark[ids[stretches(at[rows], sizes[rows])]]
        return np.add.reduceat(flat, np.cumsum(sizes[rows]) - sizes[rows], dtype=np.int64) if len(rows) else np.empty(0, np.int64)

    def reach(over, a, b):
        return over >= threshold * (a + b - over) - 1e-9

    union = np.zeros(width, bool)
    union[ids[stretches(at[members], sizes[members])]] = True
    if len(queries):
        queries = queries[overlaps(union, queries) >= threshold * sizes[queries] - 1e-9]
    rows = np.concatenate([members, queries])
    m = len(members)
    if m <= 8:
        for k in range(m):
            others = rows[k + 1 :] if inner else queries
            if not len(others):
                return
            mark = np.zeros(width, bool)
            mark[ids[at[rows[k]] : at[rows[k] + 1]]] = True
            hit = others[reach(overlaps(mark, others), sizes[rows[k]], sizes[others])]
            if len(hit):
                yield np.full(len(hit), rows[k]), hit
        return
    # columns in order of how many rows have them
    flat = ids[stretches(at[rows], sizes[rows])]
    of = np.repeat(np.arange(len(rows)), sizes[rows])
    live = union[flat]
    flat, of = flat[live], of[live]
    many = np.bincount(flat, minlength=width)
    live = many[flat] > 1
    flat, of = flat[live], of[live]
    few = many[flat] <= RARE
    pairs = [np.empty(0, np.int64)]
    order = np.argsort(flat[few], kind="stable")  # rows stay in order within a gram
    gram, row = flat[few][order], of[few][order]
    counts = many[gram]
    for d in range(2, RARE + 1):
        block = row[counts == d].reshape(-1, d)
        i, j = np.tril_indices(d, -1)
        low, high = block[:, j].ravel(), block[:, i].ravel()
        pairs.append((high * m + low)[low < m])
    pairs = np.sort(np.concatenate(pairs))
    dense_ids, column = np.unique(flat[~few], return_inverse=True)
    dense_row = of[~few]
    begin = np.searchsorted(dense_row, np.arange(len(rows) + 1))
    step = max(1, min(512, 4_000_000 // m))

    def dense(lo: int, hi: int, c: int, width_: int) -> np.ndarray:
        out = np.zeros((hi - lo, width_), np.float32)
        r, k = dense_row[begin[lo] : begin[hi]] - lo, column[begin[lo] : begin[hi]] - c
        fit = (k >= 0) & (k < width_)
        out[r[fit], k[fit]] = 1
        return out

    for lo in range(0 if inner else m, len(rows), step):
        hi = min(lo + step, len(rows))
        top = min(m, hi)
        over = np.zeros((hi - lo, top), np.float32)
        for c in range(0, len(dense_ids), 2048):
            w = min(2048, len(dense_ids) - c)
            left = dense(lo, hi, c, w)
            for mlo in range(0, top, 2048):
                mhi = min(mlo + 2048, top)
                over[:, mlo:mhi] += left @ dense(mlo, mhi, c, w).T
        a, b = np.searchsorted(pairs, [lo * m, hi * m])
        high, low = pairs[a:b] // m - lo, pairs[a:b] % m
        over += np.bincount(high * top + low, minlength=over.size).reshape(over.shape).astype(np.float32) if b > a else 0
        ok = reach(over.astype(np.int64), sizes[rows[lo:hi]][:, None], sizes[rows[:top]][None])
        j, i = np.nonzero(ok)
        fit = i < j + lo
        if fit.any():
            yield rows[i[fit]], rows[j[fit] + lo]


def _units(one: DataFrame, cells: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Where each set has to go: d, f (a document with it, of `rows` rows alike), sid, g, copies, own (the unit in which it is a member, null if none) and to: the units and groups in which it is a query, as array<struct<unit, g>>. Also the tables that were written for it.

    A unit is a number of groups near each other in the cells, or a block of a large group.
    """
    groups = one.groupBy("g").agg(F.sum("size").alias("weight"), F.count("*").alias("sets"))
    asked = cells.select("g").distinct().withColumn("asked", F.lit(True))
    groups = staged(groups.join(asked, "g", "left").where("asked OR sets > 1").select("g", "weight"), "groups")
    edges = cells.select(F.col("qg").alias("a"), F.col("g").alias("b")).distinct()
    edges = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = groups.select("g", F.col("g").alias("label"))
    for _ in range(2):
        near = edges.join(label, edges.b == label.g).groupBy("a").agg(F.min("label").alias("near"))
        label = label.join(near, label.g == near.a, "left").select("g", F.least("label", F.coalesce("near", "label")).alias("label"))
    sized = groups.join(label, "g")
    total = sized.groupBy("label").agg(F.sum("weight").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") / MOST)).cast("int")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("total") / MOST)).cast("int")
    placed = sized.join(total, "label").select("g", blocks.alias("blocks"), F.xxhash64("label", F.pmod(F.xxhash64("g"), chunks)).alias("near"))
    placed = staged(placed.withColumn("near", F.when(F.col("blocks") > 1, F.xxhash64("g", F.lit("blocks"))).otherwise(F.col("near"))), "units")

    def unit(block):
        return F.xxhash64("near", block)

    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    block = F.pmod(F.col("sid"), F.col("blocks")).cast("int")
    members = one.join(placed, "g").select("q", "sid", unit(block).alias("unit"), F.lit(None).cast("long").alias("g"), F.lit(True).alias("own"))
    # each set of a large group meets the blocks after its own
    within = one.join(placed.where("blocks > 1"), "g").select("q", "sid", "near", "g", F.explode(F.filter(each, lambda x: x > F.pmod(F.col("sid"), F.col("blocks")))).alias("x")).select("q", "sid", unit(F.col("x")).alias("unit"), "g", F.lit(False).alias("own"))
    across = cells.join(placed, "g").select("q", "near", "g", F.explode(each).alias("x")).join(one.select("q", "sid"), "q").select("q", "sid", unit(F.col("x")).alias("unit"), "g", F.lit(False).alias("own"))
    every = members.unionByName(within).unionByName(across)
    to = every.groupBy("sid").agg(F.max(F.when(F.col("own"), F.col("unit"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.struct("unit", "g"))).alias("to"))
    return to.join(one, "sid").select(F.col("k.doc").alias("d"), F.col("k.fp").alias("f"), F.col("k.rows").alias("rows"), "sid", "g", "copies", "own", "to"), [groups, edges, placed]


UNIT = "unit long, sid long, copies long, text string, member long, gs array<long>"


def _opened(there: DataFrame, n: int, threshold: float) -> DataFrame:
    """sid, other, links: the documents with other sets that each set was found to reach the threshold with, and a set of its class within the unit. there: rows of UNIT, member the group in which the row is a member or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        unit: int | None = None
        held: list[tuple] = []

        def closed() -> Iterator[pa.RecordBatch]:
            # the rows of one unit: sid, copies, group as a member, groups as a query, grams
            if len(held) < 2:
                return
            sid = np.array([r[0] for r in held])
            copies = np.array([r[1] for r in held], np.int64)
            grams = [r[4] for r in held]
            sizes = np.array([len(x) for x in grams])
            at = np.concatenate([[0], np.cumsum(sizes)])
            known, ids = np.unique(np.concatenate(grams), return_inverse=True)
            members: dict[int, list[int]] = {}
            queries: dict[int, list[int]] = {}
            for r, row in enumerate(held):
                if row[2] is not None:
                    members.setdefault(row[2], []).append(r)
                for g in row[3]:
                    queries.setdefault(g, []).append(r)
            linked = Linked(copies)
            for g, own in members.items():
                asked = np.array(queries.get(g, []), np.int64)
                # queries of many grams a part at a time
                part = np.cumsum(sizes[asked]) // MOST
                for k, some in enumerate(np.split(asked, np.flatnonzero(np.diff(part)) + 1)):
                    if len(own) + len(some) > 1:
                        for x, y in compare(np.array(own), some, at, ids, len(known), threshold, not k):
                            linked.add(x, y)
            linked.settle()
            hit = np.flatnonzero(linked.links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(sid[linked.root[hit]]), pa.array(linked.links[hit])], names=["sid", "other", "links"])

        for batch in batches:
            to, who, copies, member = (batch.column(c).to_pylist() for c in ("unit", "sid", "copies", "member"))
            gs = batch.column("gs").to_pylist()
            for rows, sizes, grams in _sets(batch, memo, n):
                at = np.cumsum(sizes) - sizes
                for r, a, z in zip(rows.tolist(), at.tolist(), sizes.tolist(), strict=True):
                    if to[r] != unit:
                        yield from closed()
                        big = sum(len(x[4]) for x in held) > MOST // 4
                        held, unit = [], to[r]
                        if big:
                            trimmed()
                    if held and held[-1][0] == who[r]:  # rows alike in doc_id and text
                        continue
                    held.append((who[r], copies[r], member[r], gs[r], grams[a : a + z].copy()))
        yield from closed()

    return there.mapInArrow(lean(run), "sid long, other long, links long")


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(sets, linked): doc, fp, rows, sid of all documents with grams, once each; sid, root, links of all sets: the class, named by its least sid, and the number of other documents that reach the threshold with one of the set. Both are staged."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must be from 0.5 to 1")
    docs = prepared(docs)
    scan, sketch = scanned(docs, n, threshold)
    firsts = [F.first(c).alias(c) for c in ("g", "size", "ask")]
    sets = staged(scan.groupBy("doc", "fp").agg(F.first("sid").alias("sid"), *firsts, F.count("*").alias("rows")), "documents")
    q = F.shiftleft("g", 32).bitwiseOR(F.col("sid").bitwiseAND(F.lit(0xFFFFFFFF)))
    one = staged(sets.groupBy("sid").agg(F.min(F.struct("doc", "fp", "rows")).alias("k"), *firsts, F.count("*").alias("copies")).withColumn("q", q), "sets")
    total = one.agg(F.sum("size").alias("n")).first()["n"] or 0
    discard(scan)
    cells = staged(_cells(docs, one.groupBy("q").agg(F.min("ask").alias("ask")), sketch, total, n, threshold), "cells")
    wanted, made = _units(one, cells)
    wanted = staged(wanted, "wanted")
    discard(cells, *made)
    there = _sent(docs, wanted).repartition(buckets(docs.sparkSession, 14 * total), "unit").sortWithinPartitions("unit", "sid")
    found = staged(_opened(there, n, threshold), "links")
    discard(wanted)
    roots = components(found.where("sid <> other").select(F.col("sid").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    linked = one.select("sid", "copies").join(links, "sid", "left").join(roots, F.col("sid") == F.col("node"), "left")
    linked = staged(linked.select("sid", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "linked")
    discard(found, one, roots)
    return sets, linked


def _sent(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of UNIT: the text of each wanted set in every unit that it goes to."""
    here = (F.col("doc") == F.col("d")) & (F.col("fp") == F.col("f"))
    size = F.size("to") * 16 + 80
    there = docs.join(small_side(wanted.where("rows = 1"), size), here).select("text", *wanted.columns)
    # rows alike in doc_id and text come together before they travel
    alike = wanted.where("rows > 1")
    if not alike.isEmpty():
        texts = docs.join(small_side(alike.select("d", "f", "sid"), 80), here).groupBy("sid").agg(F.first("text").alias("text"))
        there = there.unionByName(texts.join(alike, "sid").select("text", *wanted.columns))
    units = F.array_distinct(F.concat(F.array_compact(F.array("own")), F.col("to.unit")))
    there = there.withColumn("unit", F.explode(units))
    mine = F.transform(F.filter("to", lambda x: x["unit"] == F.col("unit")), lambda x: x["g"])
    return there.select("unit", "sid", "copies", "text", F.when(F.col("own") == F.col("unit"), F.col("g")).alias("member"), mine.alias("gs"))


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document (doc_id and text) with grams: doc_id, class_id (the least doc_id of its class that isn't null), links (how many other documents reach the threshold with it)."""
    sets, linked = similar_sets(docs, n, threshold)
    rows = sets.select("doc", "sid").join(linked, "sid")
    named = rows.groupBy("root").agg(F.min(real_id()).alias("class_id"))
    return rows.join(named, "root").select(real_id(), "class_id", "links")


def drop_near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near duplicates (connected by pairs): the one of least doc_id, null first, and of rows alike one. Columns unchanged."""
    sets, linked = similar_sets(docs, n, threshold)
    rows = sets.join(linked, "sid").select("doc", "fp", "rows", "root")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc", "fp")).alias("kept"))
    marked = rows.join(kept, "root").select("doc", "fp", (F.col("kept") == F.struct("doc", "fp")).alias("stays"), "rows")
    marked = staged(marked.where("NOT stays OR rows > 1"), "marked")
    discard(sets, linked)
    lose, alike = (small_side(marked.where(c).select("doc", "fp"), 48) for c in ("NOT stays", "stays"))
    left = rowwise(docs).join(lose, ["doc", "fp"], "left_anti")
    if marked.where("stays").isEmpty():
        return columns_of(left, docs)
    # rows alike come together before they travel
    first = left.join(alike, ["doc", "fp"], "left_semi").groupBy("doc", "fp").agg(F.first("row").alias("row"))
    return columns_of(left.join(alike, ["doc", "fp"], "left_anti").unionByName(first), docs)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT id, doc_id, list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS grams
      FROM d WHERE len(w) > 0),
g AS (SELECT id, len(grams) AS size, unnest(grams) AS gram FROM s),
p AS (SELECT x.id AS a, y.id AS b, x.size AS sa, y.size AS sb, count(*) AS o
      FROM g x JOIN g y ON x.gram = y.gram AND x.id <> y.id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE o >= {THRESHOLD} * (sa + sb - o) - 1e-9),
r(id, met) AS (SELECT id, id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON r.met = e.a),
c AS (SELECT r.id, min(s.doc_id) AS class_id FROM r JOIN s ON r.met = s.id GROUP BY r.id)
SELECT s.doc_id, c.class_id, (SELECT count(*) FROM e WHERE e.a = s.id)::BIGINT AS links FROM s JOIN c USING (id)
"""
