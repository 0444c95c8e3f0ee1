"""Packing along a space-filling curve.

Every document becomes a hashed vector: each word gives small signed counts in a few dimensions, drawn from its hash, and the document's vector is their mean. Vectors are scaled by the corpus's mean and deviation, quantised, and mapped to a Hilbert key. Documents are range-sorted by that key and their words laid end to end along the curve; sequences of a fixed length are cut out of that line, so neighbours on the curve share sequences and only the last sequence has room left.

The vector pass reads the texts once and writes a narrow table; the sort, the prefix sums and the cuts work on that. The prefix sum is distributed: sums of range partitions first (the partition number is written with the rows, so it can't change), rows within a partition then.

Defined cases: null and empty texts have no words and are in no sequence; a document longer than a sequence spans several; rows alike in doc_id and text are packed as often as they occur; ties of the key follow doc_id, null last to first as NULL_ID; other columns are ignored; an empty table gives an empty result; doc_id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Hashes, lean, partitions, pieces, prepared, real_id, staged

DIMS, BITS, LENGTH = 3, 12, 2048
SCALE = 1 << 16
_ONES = np.array([bin(x).count("1") - 4 for x in range(256)], np.int8)


def word_points(hashes: np.ndarray, dims: int) -> np.ndarray:
    """Signed counts of each word, from disjoint bytes of its hash: mean 0, deviation about 1.4."""
    return _ONES[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :dims]]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert key of integer points (n, dims), each coordinate below 2**bits; dims*bits at most 62."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vectors(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """doc, fp, n_tokens, v0.. (mean of the word points, in 1/65536)."""
    schema = "doc long, fp long, n_tokens long, " + ", ".join(f"v{i} long" for i in range(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((batch.num_rows, dims), np.int64)
            for lists, rows, _ in pieces(batch, 0):
                words = [w for x in lists for w in x]
                lengths = np.array([len(x) for x in lists])
                if words:
                    points = word_points(memo.of(words), dims).astype(np.int64)
                    full = np.flatnonzero(lengths)
                    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
                    np.add.at(sums, np.array(rows)[full], np.add.reduceat(points, starts, axis=0))
                np.add.at(n, np.array(rows), lengths)
            means = np.rint(sums * SCALE / np.maximum(n, 1)[:, None]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("fp"), pa.array(n), *(pa.array(means[:, i]) for i in range(dims))], names=["doc", "fp", "n_tokens", *(f"v{i}" for i in range(dims))])

    return prepared(docs).mapInArrow(lean(run), schema)


def curve_order(docs: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """doc, fp, n_tokens, key, part: range-sorted by (key, doc, fp), with the number of the range partition."""
    spark = docs.sparkSession
    v = staged(vectors(docs, dims).where("n_tokens > 0"), "vectors")
    exact = [F.sum(F.col(f"v{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)] + [F.sum(F.col(f"v{i}").cast("decimal(19,0)") * F.col(f"v{i}").cast("decimal(19,0)")).alias(f"q{i}") for i in range(dims)]
    row = v.agg(F.count("*").alias("n"), *exact).first()
    count = max(row["n"], 1)
    mean = [float(row[f"s{i}"] or 0) / count for i in range(dims)]
    spread = [max(float(row[f"q{i}"] or 0) / count - mean[i] ** 2, 1.0) ** 0.5 for i in range(dims)]
    top = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.stack([(b.column(f"v{i}").to_numpy() - mean[i]) / spread[i] for i in range(dims)], axis=1) if b.num_rows else np.zeros((0, dims))
            cells = np.clip(((z + 4) / 8 * top), 0, top).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("fp"), b.column("n_tokens"), pa.array(hilbert(cells, bits))], names=["doc", "fp", "n_tokens", "key"])

    keyed = v.mapInArrow(run, "doc long, fp long, n_tokens long, key long")
    ranged = keyed.repartitionByRange(partitions(spark), "key", "doc", "fp").sortWithinPartitions("key", "doc", "fp")
    return staged(ranged.withColumn("part", F.spark_partition_id()), "curve")


def pack(docs: DataFrame, length: int = LENGTH, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """One row per stretch of a document in a sequence: seq_id, seq_offset, doc_id, doc_offset, n_tokens (offsets and lengths in words)."""
    order = curve_order(docs, dims, bits)
    sums = order.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    sums = sums.select("part", ahead.alias("ahead"))
    upto = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("key", "doc", "fp").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = order.withColumn("upto", upto).join(sums, "part").withColumn("start", F.col("ahead") + F.col("upto") - F.col("n_tokens"))
    cut = laid.withColumn("seq_id", F.explode(F.expr(f"sequence(start div {length}, (start + n_tokens - 1) div {length})")))
    begin = F.greatest(F.col("start"), F.col("seq_id") * length)
    end = F.least(F.col("start") + F.col("n_tokens"), (F.col("seq_id") + 1) * length)
    return cut.select("seq_id", (begin - F.col("seq_id") * length).alias("seq_offset"), real_id(), (begin - F.col("start")).alias("doc_offset"), (end - begin).alias("n_tokens"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
