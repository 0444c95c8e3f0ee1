"""Clone groups over token streams: windows, exact grouping, maximal extension, greedy cover.

Relation: streams(file, norms array<string>, units array<int>), a row a file; a window never leaves a run of one unit.

Windows are hashed where the streams lie, and only halves of hashes and positions shuffle, as columns, to find those that recur; the content of these, and of no others, is then compared by its md5. Files' stretches of recurring windows (runs) that are alike from end to end are one, with a list of where they are, so boilerplate that a third of all files have is decided once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import staged
from .reach import components


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] at each i, by doubling."""
    out, at, size, power = None, 0, 1, h
    while size <= k:
        if k & size:
            part = power[at : at + len(h) - k + 1]
            out = part if out is None else _mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            at += size
        if size * 2 <= k:
            power = _mixed(power[:-size] * np.uint64(0xD6E8FEB86659FD93) + power[size:])
        size *= 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


#: Bytes of cells that a task takes up at once.
_CELLS = 24 << 20


def _buckets(streams: DataFrame) -> int:
    """So many that one holds about _CELLS bytes of windows, at 8 bytes a token; tables of unknown size are counted."""
    spark = streams.sparkSession
    stored = int(str(streams._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tokens = stored // 3 if stored < 1 << 50 else streams.agg(F.sum(F.size("norms"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens * 8 // _CELLS))


def recurring(streams: DataFrame, k: int) -> DataFrame:
    """f, at array<int>: positions of the runs of k tokens within one unit whose hash occurs at least twice; of a hash, 32 bits are compared within its bucket, so a few that don't recur may be among them. Several rows a file."""
    kind, n = streams.schema["file"].dataType.simpleString(), _buckets(streams)
    hashed = streams.where(F.size("norms") >= k).select("file", F.transform("norms", lambda x: F.xxhash64(x)).alias("h"), F.transform("units", lambda x: F.coalesce(x, F.lit(-1))).alias("u"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, units = batch.column("h"), batch.column("u")
            flat, of_unit = column.flatten().to_numpy().view(np.uint64), units.flatten().to_numpy()
            if len(flat) < k:
                continue
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            starts = np.concatenate([[0], ends[:-1]])
            # a window holds if no unit or file changes within it
            change = np.concatenate([[False], of_unit[1:] != of_unit[:-1]])
            change[starts] = True
            changes = np.cumsum(change)
            rolled = _rolled(flat, k)
            at = np.flatnonzero(changes[: len(rolled)] == changes[k - 1 :])
            bucket = (rolled[at] % np.uint64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at, stops = at[order], np.searchsorted(bucket[order], np.arange(n + 1))
            row = np.searchsorted(ends, at, side="right")
            pos, half = (at - starts[row]).astype(np.int32), (rolled[at] >> np.uint64(32)).astype(np.uint32)
            for b in np.flatnonzero(np.diff(stops)):
                lo, hi = stops[b], stops[b + 1]
                rows, sizes = np.unique(row[lo:hi], return_counts=True)
                files = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column("file").take(pa.array(rows)))
                cells = [pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.int32), pos[lo:hi], half[lo:hi])]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), files, *cells], names=["bucket", "files", "sizes", "pos", "half"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [[c for b in batch_of for c in b.column(name)] for batch_of in [list(batches)] for name in ("files", "sizes", "pos", "half")]
        files, sizes, pos, half = cells
        if not files:
            return
        halves = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in half])
        order = np.argsort(halves, kind="stable")
        same = halves[order[1:]] == halves[order[:-1]]
        again = np.zeros(len(halves), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        done = 0
        for f, s, p in zip(files, sizes, pos, strict=True):
            some = np.frombuffer(p.as_py(), np.int32)
            held = again[done : done + len(some)]
            done += len(some)
            if not held.any():
                continue
            upto = np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(np.frombuffer(s.as_py(), np.int32))])]
            full = np.flatnonzero(np.diff(upto))
            offsets = np.concatenate([[0], upto[full + 1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([f.values.take(pa.array(full)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(some[held]))], names=["f", "at"])

    cells = hashed.mapInArrow(send, f"bucket int, files array<{kind}>, sizes binary, pos binary, half binary")
    return cells.repartitionById(n, F.col("bucket")).mapInArrow(meet, f"f {kind}, at array<int>")


def _grams(streams: DataFrame, k: int) -> DataFrame:
    """file, pos, gram: windows whose hash recurs; gram is the md5 of their tokens with blanks between."""
    hit = recurring(streams, k).groupBy("f").agg(F.flatten(F.collect_list("at")).alias("at"))
    told = streams.select("file", "norms").join(hit, F.col("file") == F.col("f"))
    return told.select("file", F.explode(F.transform("at", lambda p: F.struct(p.cast("long").alias("pos"), F.md5(F.array_join(F.slice("norms", p + 1, F.lit(k)), " ")).alias("gram")))).alias("x")).select("file", "x.pos", "x.gram")


def shared_windows(streams: DataFrame, k: int) -> DataFrame:
    """file, pos, gram: windows that occur at least twice; gram is the md5 of their tokens with blanks between."""
    # equal hashes of different windows fall out here
    grams = staged(_grams(streams, k), "grams")
    return grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "gram", "left_semi").select("file", "pos", "gram")


def gram_groups(streams: DataFrame, k: int) -> DataFrame:
    """gram, n, first_file: windows that occur at least twice."""
    return _grams(streams, k).groupBy("gram").agg(F.count("*").alias("n"), F.min("file").alias("first_file")).where("n > 1")


def _decide(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The greedy cover over the runs of a part, each standing for all that are like it."""
    pdf = pdf.sort_values(["file", "start"])
    sigs, grams = pdf["sig"].tolist(), [list(g) for g in pdf["grams"]]
    at: dict[str, list[tuple[int, int]]] = {}
    for r, g in enumerate(grams):
        for o, x in enumerate(g):
            at.setdefault(x, []).append((r, o))
    covered = [[False] * len(g) for g in grams]
    tokens, first, members = [], [], []
    for r, g in enumerate(grams):
        for o, x in enumerate(g):
            group = at[x]
            if covered[r][o] or any(covered[q][p] for q, p in group):
                continue
            n = 1
            while all(p + n < len(grams[q]) for q, p in group) and len({grams[q][p + n] for q, p in group}) == 1:
                n += 1
            for q, p in group:
                covered[q][p : p + n] = [True] * n
            tokens.append(n + k - 1)
            first.append(f"{sigs[r]}:{o}")
            members.append([{"sig": sigs[q], "offset": p} for q, p in group])
    return pd.DataFrame({"first": first, "tokens": tokens, "members": members})


def clone_groups(streams: DataFrame, k: int) -> DataFrame:
    """tokens, members array<struct<file, start, stop>>, the longest first, then by the first member: maximal groups of equal runs of at least k tokens.

    In order of (file, position), a window that an earlier group covers starts no group, and a group with any covered member is dropped whole; a group grows to the right while all members agree and stay in their units, and covers every window inside its members. All these windows recur and lie in one run of recurring windows, so groups interact only through runs that share one, and each connected part of runs is decided by one task. Runs alike share every group at the same places; where the first of them decides, the others have nothing to add.
    """
    windows = shared_windows(streams, k)
    w = Window.partitionBy("file").orderBy("pos")
    fresh = F.when(F.lag("pos").over(w) == F.col("pos") - 1, 0).otherwise(1)
    numbered = windows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    runs = numbered.groupBy("file", "run").agg(F.min("pos").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "gram"))), lambda x: x["gram"]).alias("grams"))
    runs = staged(runs.withColumn("sig", F.md5(F.array_join("grams", ""))), "runs")
    kinds = staged(runs.groupBy("sig").agg(F.min(F.struct("file", "start")).alias("least"), F.first("grams").alias("grams")).select("sig", "least.*", "grams"), "kinds")
    star = kinds.select("sig", F.explode(F.array_distinct("grams")).alias("gram"))
    lead = star.groupBy("gram").agg(F.min("sig").alias("lead"))
    parts = components(star.join(lead, "gram").where("sig <> lead").select(F.col("sig").alias("a"), F.col("lead").alias("b")))
    placed = kinds.join(parts, F.col("sig") == F.col("node"), "left").withColumn("part", F.coalesce("root", "sig")).select("part", "sig", "file", "start", "grams")

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _decide(pdf, k)

    decided = placed.groupBy("part").applyInPandas(decide, "first string, tokens long, members array<struct<sig:string,offset:long>>")
    spots = decided.select("first", "tokens", F.explode("members").alias("m")).join(runs.select("file", "start", "sig"), F.col("m.sig") == F.col("sig"))
    begin = F.col("start") + F.col("m.offset")
    spots = spots.select("first", "tokens", F.struct("file", begin.alias("start"), (begin + F.col("tokens") - 1).alias("stop")).alias("s"))
    groups = spots.groupBy("first", "tokens").agg(F.sort_array(F.collect_list("s")).alias("members"))
    return groups.orderBy(F.desc("tokens"), F.col("members")[0]).select("tokens", "members")


def clone_lines(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """tokens, members array<struct<file, start_line, end_line>>: the groups by the lines of their first and last tokens; lines(file, lines array<int>)."""
    rows = groups.withColumn("g", F.monotonically_increasing_id()).select("g", "tokens", F.posexplode("members").alias("ordinal", "m"))
    told = rows.join(lines, F.col("m.file") == F.col("file")).select("g", "tokens", "ordinal", "file", F.element_at("lines", (F.col("m.start") + 1).cast("int")).alias("start_line"), F.element_at("lines", (F.col("m.stop") + 1).cast("int")).alias("end_line"))
    one = told.groupBy("g", "tokens").agg(F.sort_array(F.collect_list(F.struct("ordinal", "file", "start_line", "end_line"))).alias("s"))
    return one.orderBy(F.desc("tokens"), F.col("s")[0]["file"], F.col("s")[0]["start_line"]).select("tokens", F.transform("s", lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("members"))
