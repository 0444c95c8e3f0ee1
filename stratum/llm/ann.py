"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by a learned rotation (iterative quantisation: principal axes, then alternately signs and the rotation that fits them best), fitted on a bounded sample (vectors.FIT). A code is split into substrings, and each substring has an index in which a value leads to all codes that have it there. A code within radius r of the query is within floor(r / m) of it in at least one of the m substrings, so probing every value within that of the query's, in each of the m indexes, finds every code within r; those are checked in full and reranked by the cosine of the floats.

The index covers all vectors: blocks of BLOCK rows, each with its ids, codes, floats and one posting list a substring, are written once. Queries go to the blocks in groups of at most GROUP, which every task gets; a task keeps the k best of each query over all its blocks, so what it gives doesn't grow with its rows. Neither side is ever multiplied by the other's blocks.

The radius is set from the data: the exact neighbours of at most CALIBRATION queries are found against all vectors, and the radius is the one within which QUANTILE of them lie. One radius doesn't suit all: in skewed data it fits the groups of near copies, while vectors apart from them find fewer than k codes in it, or k that aren't the nearest. A vector at angle a differs in a / pi of the bits on average; a query is done when it has min(k, n - 1) rows and the radius is at least what the last one's angle would give, and one deviation. The others go through further rounds, with a radius that suffices for all of them by the same rule and by exact neighbours of a sample of them (at a radius of all bits everything is found).

op9_ann asks for the neighbours of every vector whose id is divisible by 100. On vectors without structure (independent directions) true neighbours differ in over a third of the bits, the radius is wide, and most codes pass the probes: results stay right, the work is then nearly that of a full scan for the queries.

Defined cases: rows without id or vector, with other than finite numbers, of an uncommon length or of length zero have no neighbours and are none; of several vectors of one id the least counts; ties of the cosine go to the smaller id; other columns are ignored; fewer than k others give fewer rows; an empty table gives an empty result; the id must be an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, partitions, staged, stretches
from .vectors import matrix, sample, unit, usable

K, SUBSTRING, ROUNDS, CALIBRATION, QUANTILE, BLOCK, GROUP, EVERY = 10, 8, 20, 200, 0.97, 8192, 16_384, 100


def learn_rotation(x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the code of x is the signs of (x - mean) @ axes, as many bits as dimensions (a multiple of SUBSTRING, the rest dropped)."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    bits = axes.shape[0] // SUBSTRING * SUBSTRING
    if not bits:
        raise ValueError(f"vectors need at least {SUBSTRING} dimensions")
    axes = axes[:, ::-1][:, :bits]
    rotation = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    projected = (x - mean) @ axes
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    return mean, axes @ rotation


def codes(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(rows, bits / 8) bytes."""
    return np.packbits((x - mean) @ axes > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class Postings:
    """Substring indexes of a block of codes: per substring the rows in order of their value there, and where each value begins."""

    def __init__(self, block: np.ndarray, order: np.ndarray | None = None, starts: np.ndarray | None = None) -> None:
        self.codes = block
        if order is None:
            order = np.argsort(block, axis=0, kind="stable").T.astype(np.uint16)
            starts = np.stack([np.searchsorted(block[o, j], np.arange(257)) for j, o in enumerate(order)]).astype(np.uint16)
        self.order, self.starts = order, starts

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius, in order."""
        masks = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius // len(query)).astype(np.uint8)
        hit = np.zeros(len(self.codes), bool)
        for j, value in enumerate(query):
            values = (value ^ masks).astype(np.int64)
            first = self.starts[j, values].astype(np.int64)
            hit[self.order[j, stretches(first, self.starts[j, values + 1] - first)]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], query) <= radius]


INDEX = "ids binary, codes binary, floats binary, orders binary, starts binary"


def indexed(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """The index over all vectors, a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            x = matrix(part.column("v").chunk(0))
            p = Postings(codes(x, mean, axes))
            cells = [part.column("id").to_numpy().astype(np.int64), p.codes, x, p.order, p.starts]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["ids", "codes", "floats", "orders", "starts"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held = table.slice(BLOCK).to_batches()
                rows -= BLOCK
        if rows:
            yield block(pa.Table.from_batches(held))

    return staged(vectors.mapInArrow(lean(run), INDEX), "index")


def calibrated_radius(vectors: DataFrame, asking: DataFrame, m: int, mean: np.ndarray, axes: np.ndarray, k: int = K, queries: int = CALIBRATION, quantile: float = QUANTILE) -> int:
    """The least radius that holds `quantile` of the exact k nearest neighbours of the calibration queries (at most about `queries` of the m rows of `asking`), found against all vectors."""
    qid, q = sample(asking, m, queries)
    if not len(qid):
        qid, q = sample(asking, 1, 1)
    qcode = codes(q, mean, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = matrix(b.column("v")), b.column("id").to_numpy()
            sims = q @ x.T
            sims[qid[:, None] == ids[None]] = -9
            top = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
            ham = distances(qcode[:, None], codes(x, mean, axes)[top])
            got = np.stack([np.take_along_axis(sims, top, 1), ham], 2)
            best = got if best is None else np.concatenate([best, got], axis=1)
            keep = np.argsort(-best[:, :, 0], axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(best, keep[:, :, None], 1)
        if best is not None:
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(qid)), n)), pa.array(best[:, :, 0].ravel()), pa.array(best[:, :, 1].ravel().astype(np.int64))], names=["q", "sim", "ham"])

    near = vectors.mapInArrow(lean(run), "q long, sim double, ham long").where("sim > -2").toPandas()
    near = near.sort_values(["q", "sim"], ascending=[True, False]).groupby("q").head(k)
    return int(np.ceil(np.quantile(near["ham"], quantile))) if len(near) else 0


FOUND = "vec_id long, neighbour_id long, cosine double"


def _searched(index: DataFrame, asking: DataFrame, m: int, mean: np.ndarray, axes: np.ndarray, radius: int, k: int) -> DataFrame:
    """vec_id, neighbour_id, cosine, rank: for each of the m rows of `asking` the k nearest among the codes within the radius, as many as there are."""
    spark = index.sparkSession
    groups = -(-m // GROUP)
    asked = asking.select("id", "v", F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).alias("group"))
    parts = []
    for g in range(groups):
        some = asked.where(F.col("group") == g).toPandas()
        if not len(some):
            continue
        qid, q = some["id"].to_numpy(), unit(np.array(some["v"].tolist()))
        sent = spark.sparkContext.broadcast((qid, q, codes(q, mean, axes)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q, qcode = sent.value
            best_id, best = np.full((len(qid), k), np.iinfo(np.int64).max), np.full((len(qid), k), -np.inf)
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], np.int64)
                    n, width = len(ids), qcode.shape[1]
                    block = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
                    x = np.frombuffer(row["floats"], np.float64).reshape(n, -1)
                    postings = Postings(block, np.frombuffer(row["orders"], np.uint16).reshape(width, -1), np.frombuffer(row["starts"], np.uint16).reshape(width, -1))
                    for i in range(len(qid)):
                        found = postings.within(qcode[i], radius)
                        found = found[ids[found] != qid[i]]
                        if not len(found):
                            continue
                        sims = x[found] @ q[i]
                        if len(found) > k:
                            keep = sims >= np.partition(sims, len(sims) - k)[len(sims) - k]
                            found, sims = found[keep], sims[keep]
                        all_ids, all_sims = np.concatenate([best_id[i], ids[found]]), np.concatenate([best[i], sims])
                        top = np.lexsort((all_ids, -all_sims))[:k]
                        best_id[i], best[i] = all_ids[top], all_sims[top]
            r, c = np.nonzero(best > -np.inf)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best_id[r, c]), pa.array(best[r, c])], names=["vec_id", "neighbour_id", "cosine"])

        parts.append(index.mapInArrow(lean(run), FOUND))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id"))  # k rows a task
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(df: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY) -> DataFrame:
    """vec_id, neighbour_id, cosine, rank (from 1): for every vector whose id is divisible by `every` its k nearest among all vectors (all others if there are fewer) within the radius of its round."""
    vectors = usable(df, id_col, vec_col)
    n = vectors.count()
    queries = vectors.where(F.col("id") % every == 0)
    m = queries.count()
    if not m or n < 2:
        return df.sparkSession.createDataFrame([], FOUND + ", rank int")
    _, x = sample(vectors, n)
    mean, axes = learn_rotation(x if len(x) else sample(queries, m)[1])
    index = indexed(vectors.repartition(max(partitions(df.sparkSession) // 2, -(-n // (4 * BLOCK)))), mean, axes)
    bits, full = axes.shape[1], min(k, n - 1)
    asking, radius, done = queries, calibrated_radius(vectors, queries, m, mean, axes, k), None
    while True:
        found = staged(_searched(index, asking, m, mean, axes, radius, k), "neighbours")
        # a row of rank `full` tells that all before it are there; anything nearer has a code nearer than this, but for a sixth
        share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))) / math.pi
        last = found.where(F.col("rank") == full).select("vec_id", (bits * share + F.sqrt(bits * share * (1 - share))).alias("wanted"))
        whole = last.where(F.col("wanted") <= radius).select("vec_id")
        row = last.agg(F.count("*").alias("found"), F.count_if(F.col("wanted") <= radius).alias("whole"), F.max("wanted").alias("wanted")).first()
        missing = m - row["whole"]
        if not missing or radius >= bits:
            discard(vectors, index)
            return found if done is None else done.unionByName(found)
        kept = found.join(whole, "vec_id", "left_semi").select(*found.columns)
        done = kept if done is None else done.unionByName(kept)
        asking = staged(asking.join(whole, F.col("id") == F.col("vec_id"), "left_anti"), "asking")
        radius = min(bits, max(2 * radius if row["found"] < m else radius + 1, 1, math.ceil(row["wanted"] or 0), calibrated_radius(vectors, asking, missing, mean, axes, k)))
        m = missing


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
