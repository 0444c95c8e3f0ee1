"""Graph fixpoints: two-color reachability, closures with depths and paths, inbound references, name chasing, connected parts.

Relations: edges(src, dst, kind) with kind prod or test, seeds(id, color) with color prod or test, nodes(id, ...).

Verdicts and depths spread over ids told by 128 bits of hash (`_levels`), so the edges, which every round reads whole, are numbers; where parents or paths are asked for, ids themselves spread (`_spread`).

Everything runs in rounds of joins. Each round writes only what is new to the shared folder, so lineage stays short and a lost executor costs one round; a small frontier is broadcast by its measured size, a large one shuffles. Only the number of rounds (the graph's depth, or its logarithm for chase and components) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import delete, staged

#: What a path may use: production edges only, or any.
PROD, ANY = 1, 2
_COMPACT = 8


def _bits(name: str) -> Column:
    return F.when(F.col(name) == "prod", PROD | ANY).otherwise(ANY)


def _spread(edges: DataFrame, seeds: DataFrame, paths: bool = False, until: str | None = None) -> DataFrame:
    """id, bits, depth, parent (and path): what reaches each node over edges(src, dst, bits) from seeds(id, bits). A row for every round in which a node gained bits; of parents the least. Ends early when `until` is reached."""
    carried = ["id", "bits", "depth", "parent", *(["path"] if paths else [])]
    edges = staged(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.bit_or("bits").alias("bits")), "edges")
    start = seeds.where("id IS NOT NULL").groupBy("id").agg(F.bit_or("bits").alias("bits"))
    front = staged(start.select("id", "bits", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array("id").alias("path")).select(*carried), "front")
    known, written, depth = front, [front], 0
    while not front.isEmpty() and (until is None or front.where(F.col("id") == until).isEmpty()):
        depth += 1
        onward = edges.select(F.col("src"), F.col("dst"), F.col("bits").alias("pass"))
        step = front.join(onward, front.id == onward.src).select(F.col("dst").alias("id"), F.col("bits").bitwiseAND(F.col("pass")).alias("bits"), F.lit(0).alias("had"), F.struct("src", *(["path"] if paths else [])).alias("by")).where("bits <> 0")
        # with what is known in the same shuffle
        before = known.select("id", F.lit(0).alias("bits"), F.col("bits").alias("had"), F.lit(None).cast(step.schema["by"].dataType).alias("by"))
        met = step.unionByName(before).groupBy("id").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"), F.min("by").alias("by"))
        met = met.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("had"))).where("bits <> 0")
        more = [F.concat("by.path", F.array("id")).alias("path")] if paths else []
        front = staged(met.select("id", "bits", F.lit(depth).alias("depth"), F.col("by.src").alias("parent"), *more), "front")
        written.append(front)
        known = known.unionByName(front)
        if depth % _COMPACT == 0:
            known = staged(known, "reached")
            delete(*written[:-1])
            written = [front, known]
    delete(edges)
    return known


def _told(of: str, name: str) -> list[Column]:
    """128 bits of an id as two columns, name and name2; the second is no function of the first."""
    return [F.xxhash64(of).alias(name), F.xxhash64(F.lit(1), F.col(of)).alias(f"{name}2")]


def _same(a: str, b: str) -> Column:
    """Equal in both columns; the first alone is the join's key, as one number is looked up faster than two."""
    return (F.col(a) == F.col(b)) & (F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2")) == 0)


def _levels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """h, h2, bits, depth of what edges(src, dst, bits) reach from seeds(id, bits), a row an id: all its bits, and the round of the first of them. Staged."""
    edges = staged(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*_told("src", "a"), *_told("dst", "b"), F.col("bits").cast("byte").alias("pass")), "edges")
    start = seeds.where("id IS NOT NULL").select(*_told("id", "h"), F.col("bits").cast("byte").alias("bits"))
    front = staged(start.groupBy("h", "h2").agg(F.bit_or("bits").alias("bits"), F.lit(0).alias("depth")), "front")
    known, written, depth = front, [front], 0
    while not front.isEmpty():
        depth += 1
        step = edges.join(front, _same("a", "h")).select(F.col("b").alias("h"), F.col("b2").alias("h2"), F.col("bits").bitwiseAND(F.col("pass")).alias("bits"), F.lit(0).cast("byte").alias("had")).where("bits <> 0")
        # with what is known in the same shuffle
        before = known.select("h", "h2", F.lit(0).cast("byte").alias("bits"), F.col("bits").alias("had"))
        met = step.unionByName(before).groupBy("h", "h2").agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        front = staged(met.select("h", "h2", F.col("bits").bitwiseAND(F.bitwise_not("had")).alias("bits"), F.lit(depth).alias("depth")).where("bits <> 0"), "front")
        written.append(front)
        known = known.unionByName(front)
        if depth % _COMPACT == 0:
            known = staged(_gathered(known), "reached")
            delete(*written[:-1])
            written = [front, known]
    out = staged(_gathered(known), "reached")
    delete(edges, *written)
    return out


def _gathered(levels: DataFrame) -> DataFrame:
    return levels.groupBy("h", "h2").agg(F.bit_or("bits").alias("bits"), F.min("depth").alias("depth"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, depth, parent of everything that seeds reach; a seed has depth 0 and no parent; of parents the least."""
    return _spread(edges.select("src", "dst", F.lit(ANY).alias("bits")), seeds.select("id", F.lit(ANY).alias("bits"))).select("id", "depth", "parent")


def own_file_edges(nodes: DataFrame) -> DataFrame:
    """Each symbol refers to its file, for production and for tests."""
    return nodes.select(F.col("id").alias("src"), F.col("file").alias("dst"), F.explode(F.array(F.lit("prod"), F.lit("test"))).alias("kind"))


def assembled(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, kind, n: references and own-file edges together, each once with the number of times it was there."""
    return refs.select("src", "dst", "kind").unionByName(own_file_edges(nodes)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def coloured(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """nodes with reachability: alive if production seeds reach it by production edges, else test-only if any seed does by any edge, else dead. Both colors spread together, as bits."""
    reached = _levels(edges.select("src", "dst", _bits("kind").alias("bits")), seeds.select("id", _bits("color").alias("bits"))).select("h", "h2", "bits")
    by = F.coalesce("bits", F.lit(0))
    verdict = F.when(by.bitwiseAND(F.lit(PROD)) != 0, "alive").when(by != 0, "test-only").otherwise("dead")
    return nodes.select("*", *_told("id", "n")).join(reached, _same("n", "h"), "left").select(*nodes.columns, verdict.alias("reachability"))


def two_color(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, reachability of nodes, as `coloured`."""
    return coloured(nodes.select("id"), edges, seeds)


def witness_depths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, depth: length of the shortest path from any seed to each reached node."""
    every = F.lit(ANY).alias("bits")
    reached = _levels(edges.select("src", "dst", every), seeds.select("id", every)).select("h", "h2", "depth")
    return nodes.select("id", *_told("id", "n")).join(reached, _same("n", "h")).select("id", F.col("depth").cast("long").alias("depth"))


def witness_path(edges: DataFrame, seeds: DataFrame, target: str) -> list[str] | None:
    """A shortest path from a seed to target, or None. Paths travel with the frontier, which stops at the target."""
    every = F.lit(ANY).alias("bits")
    row = _spread(edges.select("src", "dst", every), seeds.select("id", every), paths=True, until=target).where(F.col("id") == target).first()
    return list(row["path"]) if row else None


def inbound_refs(verdicts: DataFrame, edges: DataFrame) -> DataFrame:
    """id, referrer, referrer_verdict: distinct referrers of dead symbols, themselves excluded; a file's verdict is null."""
    dead = verdicts.where("reachability = 'dead'").select("id")
    # distinct where the join by id has brought them
    refs = edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("referrer")).join(dead, "id").distinct()
    return refs.join(verdicts.select(F.col("id").alias("referrer"), F.col("reachability").alias("referrer_verdict")), "referrer", "left").select("id", "referrer", "referrer_verdict")


def chase(links: DataFrame, declared: DataFrame, starts: DataFrame) -> DataFrame:
    """start, target: follow links(src, dst; of several the least dst) from each start until a declared(id) key; null for a cycle or a dead end.

    Pointer doubling: after k rounds a key has taken 2 ** k steps, or stopped. Every finite chain has a key that stops in the next round, so when no more stop, what is left runs in cycles.
    """
    step = links.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst"))
    ends = declared.select(F.col("id").alias("src"), F.lit(True).alias("hit")).distinct()
    first = step.join(ends, "src", "left").select("src", F.when(F.col("hit"), F.col("src")).otherwise(F.col("dst")).alias("dst"), F.coalesce("hit", F.lit(False)).alias("done"))
    jump = staged(first, "jump")
    left = None
    while True:
        now = jump.where("NOT done").count()
        if not now or now == left:
            break
        left = now
        onward = jump.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("done").alias("stops"))
        went = jump.where("NOT done").join(onward, F.col("dst") == F.col("at"), "left").select("src", F.coalesce("next", "dst").alias("dst"), F.coalesce("stops", F.lit(True)).alias("done"))
        before, jump = jump, staged(went.unionByName(jump.where("done")), "jump")
        delete(before)
    told = jump.where("done").select(F.col("src").alias("key"), F.col("dst").alias("last"))
    cycling = jump.where("NOT done").select(F.col("src").alias("key"), F.lit(True).alias("cycles"))
    out = starts.select(F.col("id").alias("start")).join(told, F.col("start") == F.col("key"), "left").drop("key").join(cycling, F.col("start") == F.col("key"), "left")
    out = out.select("start", F.when(F.col("cycles").isNull(), F.coalesce("last", "start")).alias("end"))
    return out.join(ends.select(F.col("src").alias("end"), "hit"), "end", "left").select("start", F.when(F.col("hit"), F.col("end")).alias("target"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected part of edges(a, b); nodes without edges don't appear. Staged.

    Every round each node takes the least root among its neighbours' and then its root's root, so rounds grow with the logarithm of the longest chain; each round is written to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("next"))
        up = step.select(F.col("node").alias("n2"), F.col("next").alias("up"))
        step = step.join(up, F.col("next") == F.col("n2"), "left").select("node", F.col("root").alias("was"), F.least("next", F.coalesce("up", "next")).alias("root"))
        step = staged(step, "roots")
        delete(roots)
        roots = step
        if roots.where("was <> root").isEmpty():
            delete(both)
            out = roots.select("node", "root")
            out.stage_path = roots.stage_path
            return out
