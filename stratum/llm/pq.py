"""Embedding near-duplicates by product quantisation.

Coarse centres (k-means on a bounded sample, vectors.FIT) make inverted lists; a vector's residual from its centre is split into subspaces, each quantised by its own codebook (k-means on the sample's residuals), and a list holds these codes with the quantisation error of each vector. A query looks up, per list and subspace, a table of distances to the codewords, and the sum of its entries is the distance to every quantised vector: asymmetric, as the query is not quantised.

Sufficient probes. With unit vectors, cosine >= threshold means a distance of at most d = sqrt(2 - 2 threshold). Let q and x be in the lists of centres o and c: each is on its own side of the plane half way between, and their distances to it sum to at most d, so that one of them is within d/2 of it. A vector probes all lists whose plane is within a margin; at a margin of d/2 one of the two finds the other, whatever the data. Along a given direction two near vectors differ by less than their whole distance: by about d / sqrt(D) if they differ in D independent ones. The margin is SPREAD times half of that (D is the participation ratio of the sample's variances), and d/2 at most: up to D = SPREAD ** 2 nothing can be missed, and beyond it a pair at the very threshold is missed only if it differs in the one direction that matters by more than SPREAD deviations. Recall is measured against brute force in the tests.

Filter. |q-x| >= |q-x'| - |x-x'| for the quantised x', so codes whose table distance exceeds d by more than the stored error can be dropped. What remains is reranked by exact cosine.

Vectors alike in every number are one with a count, so copies aren't compared with each other. A list of more than BLOCK vectors is split into blocks; its vectors and its visitors go to every block, and stream past the block's members. A pair that both sides find counts once, at the list of the side of greater number.

The result is one row a vector: its class (the connected component of all pairs that reach the threshold) and the number of vectors that it reaches the threshold with.

Defined cases: rows without id or vector, with other than finite numbers, of an uncommon length or of length zero have no row; of several vectors of one id the least counts; all ties at the threshold count (to 1e-9); other columns are ignored; an empty table gives an empty result; the id must be an integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Linked, components, discard, lean, partitions, staged
from .vectors import matrix, sample, usable

THRESHOLD, SUBSPACES, WORDS, ROUNDS, SPREAD, BLOCK, MOST_LISTS = 0.95, 8, 64, 6, 4.0, 4096, 8192


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most k centres by k-means from different rows of x."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        at = np.concatenate([nearest(x[lo : lo + 4096], centres) for lo in range(0, len(x), 4096)])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        centres = centres.copy()
        centres[at[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


class Lists:
    """Centres, codebooks and the margin of the probes."""

    def __init__(self, x: np.ndarray, n: int, threshold: float) -> None:
        self.centres = means(x, int(min(max(1, 2 * math.isqrt(n)), max(1, len(x) // 8), MOST_LISTS)))
        self.parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        r = x - self.centres[nearest(x, self.centres)]
        self.books = [means(r[:, p], WORDS, seed=j) for j, p in enumerate(self.parts)]
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
        variance = np.linalg.eigvalsh(np.cov(x.T).reshape(x.shape[1], -1)) if len(x) > 1 else np.ones(1)
        directions = max(variance.sum() ** 2 / max((variance**2).sum(), 1e-300), 1.0)
        self.margin = min(SPREAD / math.sqrt(directions), 1.0) * self.reach / 2 + 1e-7

    def coded(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors) of the residuals from the own centres."""
        r = x - self.centres[own]
        code = np.stack([nearest(r[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([b[code[:, j]] for j, b in enumerate(self.books)], axis=1)
        return code, np.sqrt(((r - back) ** 2).sum(1))

    def probed(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists besides its own that each row probes."""
        c = self.centres
        norms = (c * c).sum(1)
        gap = norms[None] - 2 * x @ c.T
        gap -= gap[np.arange(len(x)), own][:, None]
        between = np.sqrt(np.maximum(norms[own][:, None] + norms[None] - 2 * c[own] @ c.T, 0))
        close = gap <= 2 * self.margin * between + 1e-9
        close[np.arange(len(x)), own] = False
        return np.nonzero(close)

    def candidates(self, q: np.ndarray, centre: int, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) whose table distance doesn't rule them out."""
        r = q - self.centres[centre]
        far = np.zeros((len(q), len(code)), np.float32)
        for j, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            far += ((r[:, p][:, None] - b[None]) ** 2).sum(2).astype(np.float32)[:, code[:, j]]
        return np.nonzero(np.sqrt(far) <= (self.reach + error + 1e-4)[None])


ROUTED = "cell int, own boolean, key long, copies long, home int, probes array<int>, v array<{}>, code binary, error double"


def near_classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, class_id (the least id of its class), links (how many other vectors reach the threshold with it) of every usable vector."""
    spark = df.sparkSession
    vectors = usable(df, id_col, vec_col)
    number = vectors.schema["v"].dataType.elementType.simpleString()
    # vectors alike are one; 64 bits of hash tell vectors apart
    keyed = vectors.select("id", F.xxhash64("v").alias("key"), "v")
    one = staged(keyed.groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("copies")), "kinds")
    n = one.count()
    x = sample(one.withColumnRenamed("key", "id"), n)[1]
    if not len(x):
        x = sample(one.withColumnRenamed("key", "id"), 1)[1]
    linked = _linked(one, x, n, threshold, number) if n else None
    members = keyed.select("id", "key")
    if linked is None:
        return members.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    rows = members.join(linked, "key")
    named = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.join(named, "root").select(F.col("id").alias("vec_id"), "class_id", "links")


def _linked(one: DataFrame, x: np.ndarray, n: int, threshold: float, number: str) -> DataFrame:
    """key, root, links of all kinds of vectors."""
    spark = one.sparkSession
    lists = Lists(x, n, threshold)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = matrix(part.column("v"))
                own = nearest(x, lists.centres)
                code, error = lists.coded(x, own)
                row, cell = lists.probed(x, own)
                many = np.bincount(row, minlength=len(x))
                probes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(cell.astype(np.int32)))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                # once as a member of the own list, and as a visitor of each list that is probed
                to = np.concatenate([np.arange(len(x)), row])
                mine = np.arange(len(to)) < len(x)
                take = pa.array(to)
                nothing = pa.nulls(len(row), pa.list_(pa.int32())), pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, cell]).astype(np.int32)),
                        pa.array(mine),
                        part.column("key").take(take),
                        part.column("copies").take(take),
                        pa.array(own[to].astype(np.int32)),
                        pa.concat_arrays([probes, nothing[0]]),
                        part.column("v").take(take),
                        pa.concat_arrays([codes, nothing[1]]),
                        pa.array(np.where(mine, error[to], 0.0)),
                    ],
                    names=["cell", "own", "key", "copies", "home", "probes", "v", "code", "error"],
                )

    routed = staged(one.mapInArrow(lean(route), ROUTED.format(number)), "routed")
    blocks = routed.where("own").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = routed.join(F.broadcast(blocks), "cell")  # a row a list, MOST_LISTS at most
    mine = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a member meets the members of its block there, and those of later blocks as a visitor
    sent = spread.withColumn("block", F.explode(F.when(F.col("own"), F.filter(every, lambda b: b >= mine)).otherwise(every))).withColumn("own", F.col("own") & (F.col("block") == mine))
    sent = sent.repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", F.desc("own"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        members: list[tuple] = []
        visitors: list[tuple] = []
        block: tuple | None = None

        def joined(rows: list[tuple]) -> tuple:
            return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), np.stack([r[3] for r in rows])

        def opened() -> None:
            nonlocal block
            if block is None and members:
                code = np.stack([np.frombuffer(r[4], np.uint8) for r in members])
                block = (*joined(members), code, np.array([r[5] for r in members]))

        def met(linked: Linked, key: np.ndarray, x: np.ndarray, start: int, inner: bool, home: np.ndarray | None = None, order: np.ndarray | None = None) -> None:
            mkey, _, _, mx, code, error = block
            step = max(1, min(512, 2_000_000 // len(mkey)))
            for lo in range(0, len(key), step):
                i, k = lists.candidates(x[lo : lo + step], at[0], code, error)
                i = i + lo
                keep = k < i if inner else np.ones(len(i), bool)
                if home is not None:
                    # if the member probes the visitor's list too, the pair counts at the list of the side of greater key
                    back = (k.astype(np.int64) << 32) | home[i]
                    both = np.isin(back, order)
                    keep &= ~both | (mkey[k] > key[i])
                i, k = i[keep], k[keep]
                for a in range(0, len(i), 100_000):
                    s = slice(a, a + 100_000)
                    near = np.einsum("ij,ij->i", x[i[s]], mx[k[s]]) >= threshold - 1e-9
                    linked.add(i[s][near] + start, k[s][near])

        def told(linked: Linked, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            linked.settle()
            hit = np.flatnonzero(linked.links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(keys[linked.root[hit]]), pa.array(linked.links[hit])], names=["key", "other", "links"])

        def within() -> Iterator[pa.RecordBatch]:
            opened()
            if block is not None and len(members) > 1:
                linked = Linked(block[1])
                met(linked, block[0], block[3], 0, True)
                yield from told(linked, block[0])

        def visited() -> Iterator[pa.RecordBatch]:
            opened()
            if block is not None and visitors:
                key, copies, home, x = joined(visitors)
                own = home == at[0]
                order = np.array([(k << 32) | c for k, r in enumerate(members) for c in r[6]], np.int64)
                linked = Linked(np.concatenate([block[1], copies]))
                # those of the list's other blocks, then those of other lists
                for some, from_ in ((own, None), (~own, home)):
                    pick = np.flatnonzero(some)
                    if len(pick):
                        part = Shifted(linked, len(block[0]), pick)
                        met(part, key[pick], x[pick], 0, False, None if from_ is None else from_[pick], order)
                yield from told(linked, np.concatenate([block[0], key]))
            visitors.clear()

        for batch in batches:
            x = matrix(batch.column("v"))
            names = ("cell", "block", "own", "key", "copies", "home", "code", "error", "probes")
            for k, (cell, number, own, key, copies, home, code, error, probes) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if (cell, number) != at:
                    if at is not None:
                        yield from within()
                        yield from visited()
                    at, block = (cell, number), None
                    members.clear()
                    visitors.clear()
                if own:
                    members.append((key, copies, home, x[k], code, error, probes))
                else:
                    visitors.append((key, copies, home, x[k]))
                    if len(visitors) >= BLOCK:
                        yield from visited()
        if at is not None:
            yield from within()
            yield from visited()

    found = staged(sent.select("cell", "block", "own", "key", "copies", "home", "code", "error", "probes", "v").mapInArrow(lean(run), "key long, other long, links long"), "links")
    discard(routed)
    roots = components(found.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    out = one.select("key", "copies").join(links, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
    out = staged(out.select("key", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "linked")
    discard(found, one, roots)
    return out


class Shifted:
    """Adds pairs of picked visitors and members to a Linked in which the visitors come after the members."""

    def __init__(self, linked: Linked, members: int, pick: np.ndarray) -> None:
        self.linked, self.members, self.pick = linked, members, pick

    def add(self, visitor: np.ndarray, member: np.ndarray) -> None:
        self.linked.add(self.pick[visitor] + self.members, member)


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(table: str) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM {table}),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD} - 1e-9),
r(id, met) AS (SELECT id, id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON r.met = e.a),
c AS (SELECT id, min(met) AS class_id FROM r GROUP BY id)
SELECT id AS vec_id, class_id, (SELECT count(*) FROM e WHERE e.a = id)::BIGINT AS links FROM c
"""


SQL = _sql("embeddings")
#: The table itself has no near copies at small sizes; here every vector whose id is divisible by 5 has two, at cosines of about 0.97 and 0.94 to 0.97.
PLANTED = """(SELECT vec_id, embedding FROM embeddings
UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: (x * CASE WHEN i % 4 = 0 THEN 1.5 ELSE 1 END)::FLOAT) FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT -1000000 - vec_id, list_transform(embedding, lambda x, i: (x * CASE WHEN i % 3 = 0 THEN 1.75 ELSE 1 END)::FLOAT) FROM embeddings WHERE vec_id % 5 = 0)"""


def embedding_near_copies(spark, sf_dir: str) -> DataFrame:
    """The operator over the table and near copies planted into it."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def copies(shift: int, every: int, factor: float) -> DataFrame:
        scaled = F.transform("embedding", lambda x, i: (x * F.when((i + 1) % every == 0, factor).otherwise(1)).cast("float"))
        return table.where("vec_id % 5 = 0").select((F.lit(shift) - F.col("vec_id")).alias("vec_id"), scaled.alias("embedding"))

    return near_classes(table.unionByName(copies(-1, 4, 1.5)).unionByName(copies(-1_000_000, 3, 1.75)))


PLANTED_SQL = _sql(PLANTED)
