"""Shared pieces: staged tables, document identity, byte-level word splitting, word hashing and a columnar exchange.

A *word* is a maximal run of characters other than ASCII white space, here and in the SQL.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reach import components  # noqa: F401
from ..stage import discard, stage_root, staged  # noqa: F401

#: Stands for a null doc_id; `identity` tells rows without one apart where documents are counted.
NULL_ID = -(2**63)
WORD = r"[^ \t\n\x0B\f\r]+"
SQL_WORD = "[^ \\t\\n\\v\\f\\r]+"


def small_side(table: DataFrame, row_bytes: Column | int) -> DataFrame:
    """table, marked for broadcast if its measured size is within the session's autoBroadcastJoinThreshold; if not, both sides shuffle, and table is the one that is hashed. table should be a written one, as it is read for its size."""
    spark = table.sparkSession
    size = table.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).first()["b"] or 0
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return F.broadcast(table) if size <= most else table.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(doc_id: Column | None = None) -> Column:
    return F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("long"), F.lit(NULL_ID)).alias("doc")


def fingerprint(text: Column | None = None) -> Column:
    """Tells apart rows that share a doc_id but not the text."""
    return F.xxhash64(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit(""))).alias("fp")


#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults; a batch lies in the JVM and in the worker at once, and whole texts are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def checked(docs: DataFrame) -> DataFrame:
    """docs, if its doc_id is an integer: results carry it as one."""
    batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    return docs


def batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has a size of its own."""
    for key, (default, smaller) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, smaller)


def prepared(docs: DataFrame) -> DataFrame:
    return checked(docs).select(doc_key(), fingerprint(), F.col("text").cast("string").alias("text"))


def rowwise(docs: DataFrame) -> DataFrame:
    """doc, fp and the whole row as one struct `row`, so that no name of its columns can clash with one used inside."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return checked(docs).select(row).select("row", doc_key(F.col("row.doc_id")), fingerprint(F.col("row.text")))


def columns_of(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of `row`, some of them computed anew."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def identity(doc: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """What tells documents apart: the doc_id, and the text's hash in rows without one."""
    return np.where(doc == NULL_ID, fp, doc)


def real_id(col: str = "doc") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Hashes(dict):
    """word -> 64-bit hash, kept while it is small; a bounded memory of frequent words, not a vocabulary."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 texts without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, overlap: int, most_words: int = 250_000, columns: tuple[str, ...] = ("doc", "fp")) -> Iterator[tuple[list[list[bytes]], list[int], list[int]]]:
    """Documents of a batch as (word lists, row numbers, word offsets), together at most about most_words words.

    A document of more words comes in several pieces that share `overlap` words, so memory stays bounded for any text length while every window of overlap+1 words is in exactly one piece.
    """
    lists: list[list[bytes]] = []
    rows: list[int] = []
    starts: list[int] = []
    total = 0
    column = batch.column("text")
    for row in range(len(column)):
        if row % 512 == 0:  # a part of the texts at a time
            some = texts(column.slice(row, 512))
        words = some[row % 512].split()
        at = 0
        while True:
            part = words[at : at + most_words]
            if lists and total + len(part) > most_words:
                yield lists, rows, starts
                lists, rows, starts, total = [], [], [], 0
            lists.append(part)
            rows.append(row)
            starts.append(at)
            total += len(part)
            at += most_words - overlap
            if at + overlap >= len(words):
                break
    if lists:
        yield lists, rows, starts


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] at each i (k >= 1) by doubling; len(h)-k+1 values."""
    have, out, size = 0, None, 1
    power = h
    at = 0
    while size <= k:
        if k & size:
            out = power[at : at + len(h) - k + 1] if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + power[at : at + len(h) - k + 1])
            at += size
        have = size
        size *= 2
        if size <= k:
            power = mix(power[:-have] * np.uint64(0xD6E8FEB86659FD93) + power[have:])
    return out if k > 1 else mix(out)


BLOB = "bucket int, payload binary"


def packed(bucket: np.ndarray, columns: list[np.ndarray], n: int, ragged: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, planes: bool = False) -> pa.RecordBatch:
    """Rows as one binary cell per bucket: a shuffle of columns instead of rows. ragged: (values, first, size) adds to each row the stretch values[first:first+size]; its size must be recoverable from the columns. planes: its bytes are stored by significance, which lets the shuffle's compression find the even ones."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    if ragged is not None:
        values, first, size = ragged[0], ragged[1][order], ragged[2][order]
        stops = np.concatenate([[0], np.cumsum(size)])
        flat = values[stretches(first, size)]
    keys, cells = [], []
    for b in np.flatnonzero(np.diff(ends)):
        lo, hi = ends[b], ends[b + 1]
        parts = [np.int64(hi - lo).tobytes(), *(c[lo:hi].tobytes() for c in columns)]
        if ragged is not None:
            some = flat[stops[lo] : stops[hi]]
            parts.append((some.view(np.uint8).reshape(-1, some.itemsize).T if planes else some).tobytes())
        keys.append(b)
        cells.append(b"".join(parts))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(cells, pa.binary())], names=["bucket", "payload"])


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... (size[i] of them) for every i, end to end."""
    stops = np.cumsum(size)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - size), size)


def unpacked(cells: list[bytes], dtypes: list[np.dtype], ragged: np.dtype | None = None, planes: bool = False) -> list[np.ndarray]:
    """The inverse, over all cells of a partition; the ragged values come last."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes] + [[]]
    for cell in cells:
        n, at = int(np.frombuffer(cell, np.int64, 1)[0]), 8
        for k, t in enumerate(dtypes):
            parts[k].append(np.frombuffer(cell, t, n, at))
            at += n * np.dtype(t).itemsize
        if ragged is not None:
            some = np.frombuffer(cell, np.uint8 if planes else ragged, -1, at) if at < len(cell) else np.empty(0, ragged)
            parts[-1].append(np.ascontiguousarray(some.reshape(np.dtype(ragged).itemsize, -1).T).view(ragged).ravel() if planes and len(some) else some)
    kinds = [*dtypes, ragged] if ragged is not None else list(dtypes)
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, kinds, strict=False)]


_LIBC = ctypes.CDLL(None)


def trimmed() -> None:
    """Give memory that is free in this process back to the system: a worker lives on from stage to stage, several of them to an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which leaves no free memory behind."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trimmed()

    return wrapped


#: Bytes of cells that one task takes up at once in Python; the number of buckets follows from the data's size.
BUCKET = 24 << 20


def buckets(spark: SparkSession, size: int) -> int:
    """So many that a bucket of `size` bytes' even share is at most BUCKET, and every partition has one."""
    return max(partitions(spark), -(-size // BUCKET))


def exchanged(blobs: DataFrame, reduce: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str, n: int) -> DataFrame:
    """Bring the cells of each bucket to the task of that number and run reduce on all of them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [c for b in batches for c in b.column("payload").to_pylist()]
        if cells:
            yield from reduce(cells)

    return blobs.repartitionById(n, F.col("bucket")).mapInArrow(lean(run), schema)


class Linked:
    """Counts the links of rows and joins them into classes, as pairs come; memory grows with the rows only."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.links, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links += np.bincount(a, self.weights[b], len(self.root)).astype(np.int64) + np.bincount(b, self.weights[a], len(self.root)).astype(np.int64)
        self.held.append((a, b))
        self.pending += len(a)
        if self.pending > 500_000:
            self.settle()

    def settle(self) -> None:
        a, b = (np.concatenate([h[k] for h in self.held]) if self.held else np.empty(0, np.int64) for k in (0, 1))
        self.held, self.pending = [], 0
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root
